"""Expressions over raw record fields: wrapped values, links, defaults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from abstracta.schema import PDF_BASE


def unwrap_value(json_text: Column) -> Column:
    """``{"value": v}`` gives v, anything else itself, both as text.

    Objects and arrays stay JSON text, scalars lose their quotes, and a JSON null is NULL.
    Text that only begins like JSON (``"Why?": an answer``, ``{a}-b``) is left as it is.
    """
    start = F.left(F.ltrim(json_text), F.lit(1))
    # One parse in the usual case; the key list only tells a null value from a missing one.
    without_value = ~F.array_contains(F.json_object_keys(json_text), "value")
    unwrapped = F.coalesce(F.get_json_object(json_text, "$.value"), F.when(without_value, json_text))
    unquoted = F.coalesce(F.get_json_object(json_text, "$"), json_text)
    # The parser stops at the end of a value; inside brackets, what follows it is an error.
    listed = F.try_parse_json(F.when(start.isin("{", '"'), F.concat(F.lit("["), json_text, F.lit("]"))))
    whole = listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return (
        F.when(whole & (start == "{"), unwrapped)
        .when(whole & (start == '"'), unquoted)
        .when(json_text != "null", json_text)
    )


def unwrap_content(content: Column) -> Column:
    return F.transform_values(content, lambda _key, value: unwrap_value(value))


def rename_keys(content: Column, renames: Mapping[str, str]) -> Column:
    """Rename map keys; keys not listed stay."""
    if not renames:
        return content
    table = F.create_map(*[F.lit(part) for pair in renames.items() for part in pair])
    return F.transform_keys(content, lambda key, _value: F.coalesce(table[key], key))


def normalize_pdf_url(value: Column, base: str = PDF_BASE) -> Column:
    """Prefix non-empty values that do not already start with ``base``."""
    relative = (value != "") & ~F.startswith(value, F.lit(base))
    return F.when(relative, F.concat(F.lit(base), F.ltrim(value, F.lit("/")))).otherwise(value)


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""
    parts = F.split(path, "/")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def step(stack: Column, part: Column) -> Column:
        popped = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        return (
            F.when(part == "..", popped).when(part == ".", stack).otherwise(F.array_append(stack, part))
        )

    kept = F.aggregate(inner, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1)
    closed = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen from the page ``base`` (RFC 3986 reference resolution)."""
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_fragment = F.regexp_extract(base, r"\A([^#]*)", 1)
    no_query = F.regexp_extract(base, r"\A([^?#]*)", 1)
    base_path = F.substr(no_query, F.length(root) + 1)
    folder = F.regexp_extract(base_path, r"(?s)\A(.*/)", 1)
    href_path = F.regexp_extract(href, r"\A([^?#]*)", 1)
    href_tail = F.substr(href, F.length(href_path) + 1)
    merged = F.when(F.startswith(href, F.lit("/")), href_path).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), href_path)
    )
    dotted = merged.rlike(r"(?:\A|/)\.\.?(?:/|\z)")
    clean = F.when(dotted, _without_dot_segments(merged)).otherwise(merged)
    return (
        F.when(href == "", base)
        .when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("#")), F.concat(no_fragment, href))
        .when(F.startswith(href, F.lit("?")), F.concat(no_query, href))
        .otherwise(F.concat(root, clean, href_tail))
    )


def coalesce_title(detail_title: Column, list_title: Column) -> Column:
    """Detail title, or the list title where the former is missing or empty."""
    return F.coalesce(F.nullif(detail_title, F.lit("")), list_title)


# Classes of the statistics and what names them in a venue text, the first that fits.
DECISIONS = (
    ("withdrawn", r"(?i)\bwithdr[ae]wn\b"),
    ("rejected", r"(?i)\breject(?:ed)?\b"),
    ("submitted", r"(?i)\bsubmi(?:tted|ssion)\b"),
    ("oral", r"(?i)\b(?:oral|notable[ -]top[ -]5%)"),
    ("spotlight", r"(?i)\b(?:spotlight|notable[ -]top[ -]25%)"),
    ("poster", r"(?i)\bposter\b"),
)


def decision_class(venue: Column) -> Column:
    """Class of a venue text such as ``ICLR 2025 Oral``; NULL where none is named."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(DECISIONS):
        found = F.when(venue.rlike(pattern), name).otherwise(found)
    return found
