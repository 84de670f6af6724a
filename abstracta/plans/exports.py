"""Exported results: write them, read them back, file names, BibTeX."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from abstracta.functions.text import safe_filename, strip_text
from abstracta.operators.ranking import dense_position
from abstracta.session import scratch_path
from abstracta.sources.textfiles import export_block

# Fixed patterns of the export format. White space may cross line ends, so an empty field
# takes the next line; a link counts only if it ends in .pdf.
_SPACE = r"(?:[\s\x1c-\x1f])*"
TITLE = rf"(?Ud)Title:{_SPACE}(.*)"
VENUE = rf"(?Ud)Venue:{_SPACE}(.*)"
LINK = rf"(?U)Link:{_SPACE}(https?://[^\s\x1c-\x1f]+\.pdf)"
AFFINITY = rf"(?U)Affinity Score:{_SPACE}([0-9.]+)"
BIBTEX = rf"(?U)BibTeX:{_SPACE}\n(@[\s\S]*?\n\}})"


def _first(text: Column, pattern: str) -> Column:
    """Stripped first match, NULL for none (an empty group stays empty).

    ``regexp_extract`` gives an empty string in both cases, the list of matches does not.
    """
    return strip_text(F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0)))


def export_results(records: DataFrame) -> DataFrame:
    """Add the text ``block`` of each result row."""
    return records.withColumn(
        "block", export_block(F.col("title"), F.col("venue"), F.col("link"), F.col("score"), F.col("bibtex"))
    )


def parse_export_entry(blocks: DataFrame, value: str = "value") -> DataFrame:
    """Add ``title, venue, link, affinity`` read from each entry.

    An affinity that is no number (``1.2.3``) is NULL.
    """
    text = F.col(value)
    return blocks.withColumns(
        {
            "title": _first(text, TITLE),
            "venue": _first(text, VENUE),
            "link": _first(text, LINK),
            "affinity": _first(text, AFFINITY).try_cast("double"),
        }
    )


def complete_entries_only(entries: DataFrame) -> DataFrame:
    """Entries with all of title, venue, PDF link and score."""
    return entries.dropna(subset=["title", "venue", "link", "affinity"])


def download_manifest(blocks: DataFrame, keys: Sequence[str] = ("file",), position: str = "pos") -> DataFrame:
    """``keys..., rank, link, file_name`` of every complete entry, ranked in file order."""
    complete = complete_entries_only(parse_export_entry(blocks)).drop("value")
    ranked = dense_position(complete, position, "rank", start=1, keys=keys)
    name = safe_filename(F.col("rank"), F.col("affinity"), F.col("venue"), F.col("title"))
    return ranked.select(*keys, "rank", "link", name.alias("file_name"))


def extract_bibtex(texts: DataFrame, *keep: str, value: str = "value") -> DataFrame:
    """One row per BibTeX entry: ``keep..., n, bibtex``.

    An entry ends at the first line that starts with ``}``. On whole files an entry closed
    at the end of its last line runs on into the next one; on single blocks it cannot.
    """
    found = F.regexp_extract_all(value, F.lit(BIBTEX), F.lit(1))
    return texts.select(*keep, F.posexplode(found).alias("n", "_entry")).select(
        *keep, "n", strip_text(F.col("_entry")).alias("bibtex")
    )


def write_bibtex(entries: DataFrame, order: Sequence[str], path: str, rows_per_file: int = 100_000) -> None:
    """Write entries a blank line apart, one line feed after the last; no entry is an error.

    Part files in name order are the ``.bib`` text; up to ``rows_per_file`` entries are one
    file. Entries stand in ``order`` (null first), ties in order of their text; null and empty
    ones are left out. The input is evaluated once: it is landed in the shared folder, and
    counted and sorted from there.
    """
    spark, named = entries.sparkSession, [f"_by{i}" for i in range(len(order))]
    wanted = entries.where(F.col("bibtex") != "").select(*[F.col(c).alias(n) for c, n in zip(order, named)], "bibtex")
    landed_at = scratch_path(spark, "bibtex-entries")
    wanted.write.parquet(landed_at)
    landed = spark.read.schema(wanted.schema).parquet(landed_at)
    n = landed.count()
    if not n:
        raise ValueError("No BibTeX entries found in the input.")

    def spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first range holds the smallest entry, the only one without a line feed in front.
        first = TaskContext.get().partitionId() == 0
        for batch in batches:
            if batch.num_rows:
                lines = ["\n" + text for text in batch.column(0).to_pylist()]
                lines[0] = lines[0][1:] if first else lines[0]
                first = False
                yield pa.RecordBatch.from_pydict({"value": lines})

    files = max(1, -(-n // rows_per_file))
    ranged = landed.repartitionByRange(files, *named, "bibtex").sortWithinPartitions(*named, "bibtex")
    lines = ranged.select("bibtex").mapInArrow(spaced, "value string")
    lines.write.mode("errorifexists").option("lineSep", "\n").text(path)
