"""The thirteen operators as queries over the driver tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from abstracta.llm import (
    chat, decontaminate, filter_audit, licenses, mixing, prefix_trie, sentence_pieces, simhash, suffix, token_counts, topk,
    toxicity, warc,
)
from abstracta.llm.common import stored
from abstracta.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(key: str, sql: str | None = None):
    def add(query):
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return add


@registered(
    "op1_topk_search",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
               FROM embeddings WHERE embedding IS NOT NULL),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, _remainder() != 1)


@registered("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(_remainder() == 1, F.lit(False))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


#: Edits of every text: its first line once more in the middle, a stretch cut, the end replaced.
_EDITS = """
array(
  named_struct('start', n DIV 2, 'end', n DIV 2, 'text', substring_index(body, '\n', 1)),
  named_struct('start', n DIV 4, 'end', n DIV 4 + 40, 'text', ''),
  named_struct('start', n - 10, 'end', n + 1000000000, 'text', ' 2nd edition, don''t panic'))
"""


@registered("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("body", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("n", F.length("body").cast("long"))
    return token_counts.edited_counts(docs.select("doc_id", "text", F.expr(_EDITS).alias("edits")))


@registered("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(table(spark, sf_dir, "documents"))


@registered("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@registered("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
_CHAT_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
chunks AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    length('<|im_start|>') + length({_ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")}) + 1
      + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1 AS n
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS media_tokens
FROM chunks GROUP BY conv_id
"""


@registered("op7_chat_formatting", _CHAT_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_turns(chat.text_turns(rows.unionByName(extra))))


@registered(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN first <> page_id THEN first END AS refers_to
    FROM d LEFT JOIN f USING (payload_digest)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = stored(warc.write_archive(table(spark, sf_dir, "pages")), "warc")
    return warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS drawn FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS kind FROM d GROUP BY source),
w AS (
  SELECT *, CAST(kind + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS room,
    CAST(sum(source_size) OVER () AS DOUBLE) AS all_words FROM s),
o AS (
  SELECT *,
    coalesce(sum(room) OVER (ORDER BY room / weight, source IS NOT NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (ORDER BY room / weight, source IS NOT NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS thirsty FROM w),
l AS (SELECT *, room * thirsty <= (all_words - filled) * weight AS is_full FROM o),
t AS (
  SELECT *, CASE WHEN is_full THEN room ELSE (all_words - sum(CASE WHEN is_full THEN room ELSE 0 END) OVER ()) * weight
    / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target FROM l),
p AS (
  SELECT doc_id, size, source_size, target, kind, CAST(round(target) AS BIGINT) AS words,
    CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY drawn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, passes * size + greatest(0, least(size, words - passes * source_size - begin_at)) AS taken FROM p),
q AS (
  SELECT *, (begin_at + (CASE WHEN passes > 0 THEN size ELSE taken END) / 2.0) / words AS share FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
  round(CASE WHEN taken > 0 THEN CASE kind
    WHEN 0 THEN (sqrt(greatest(0, 2.25 - 2 * share)) - 1.5) / -1.0
    WHEN 1 THEN share
    ELSE (sqrt(greatest(0, 2.25 + 6 * (share * 3))) - 1.5) / 3.0 END END, 6) AS position
FROM q
"""


@registered("op9_mixing", _MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.training_order(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.withColumn("position", F.round("position", 6)).drop("positions")


#: Every pass of a document at its own place in the source's cumulative demand.
_PASSES_SQL = _MIX_SQL.partition("k AS (")[0] + r"""
n AS (
  SELECT *, least(size, words - pass * source_size - begin_at) AS n_words
  FROM p, (SELECT unnest(range(0, 4)) AS pass) WHERE pass <= passes),
q AS (
  SELECT *, (pass * source_size + begin_at + n_words / 2.0) / words AS share FROM n WHERE n_words > 0)
SELECT doc_id, CAST(pass AS INTEGER) AS pass, CAST(n_words AS BIGINT) AS words,
  round(CASE kind
    WHEN 0 THEN (sqrt(greatest(0, 2.25 - 2 * share)) - 1.5) / -1.0
    WHEN 1 THEN share
    ELSE (sqrt(greatest(0, 2.25 + 6 * (share * 3))) - 1.5) / 3.0 END, 6) AS position
FROM q
"""


@registered("op9_training_passes", _PASSES_SQL)
def op9_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes = mixing.training_passes(mixing.mix(table(spark, sf_dir, "documents")))
    return passes.withColumn("position", F.round("position", 6))


def _license_sql(wanted=licenses.TEMPLATES) -> str:
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    listed = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    phrases = ", ".join(f"({listed(p)}, '{label}')" for p, label in licenses.PHRASES)
    templates = ", ".join(f"(list_distinct({listed(t)}), '{label}')" for t, label in wanted)
    return f"""
    WITH phrases(p, label) AS (VALUES {phrases}), templates(t, label) AS (VALUES {templates}),
    d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents),
    places AS (SELECT n, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS place FROM d, phrases),
    base AS (SELECT n, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY n),
    blocks AS (SELECT n, list_distinct({words.format("line")}) AS b FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d)),
    met AS (SELECT n, label, len(list_intersect(b, t)) / len(t) AS share FROM blocks, templates
            WHERE len(list_intersect(b, t)) >= ceil(0.8 * len(t) - 1e-9)),
    found AS (SELECT n, label, share FROM met UNION ALL SELECT n, label, 1.0 FROM places),
    labels AS (SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY n)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
      CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM d LEFT JOIN base USING (n) LEFT JOIN labels USING (n)
    """


@registered("op10_license_sentences", _license_sql())  # the name under which the last template began
@registered("op10_license_scan", _license_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_TRIE_SQL = r"""
WITH bytes AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
      lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda x, bit: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM bytes),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, p, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS depth, sha256(role || chr(0) || text) AS said,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt),
paths AS (
  SELECT conv_id, depth, words, sha256(string_agg(said, '' ORDER BY depth) OVER
    (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
members AS (
  SELECT p.*, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS is_end FROM paths p
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs,
    (count(*) - 1) * any_value(words) AS saved, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (is_end), '') AS ends
  FROM members GROUP BY node),
kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT p.node, sum(d.saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes d LEFT JOIN kids k ON k.parent = d.node JOIN paths p ON p.conv_id = d.conv_id AND p.depth <= d.depth GROUP BY p.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
  b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN kids k ON k.parent = n.node LEFT JOIN nodes u ON u.node = n.parent
"""


@registered("op11_prefix_trie", _TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.grafted(turns))


_AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN l USING (doc_id)),
s AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, filter_order[:step - 1] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, letter, s.*,
    len(list_intersect(string_split(failed, ''), string_split(before, ''))) > 0 AND before <> '' AND failed <> '' AS gone,
    contains(failed, letter) AS fails FROM steps, s),
sums AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM sums
"""


@registered("op12_filter_audit", _AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = filter_audit.failures(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.failed_sets(flags, table(spark, sf_dir, "labels")))


@registered("op13_sentence_pieces")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentence_pieces.encode(table(spark, sf_dir, "documents"))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
