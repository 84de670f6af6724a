"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The 64 fingerprint bits are cut into three segments of 22, 21 and 21 bits, each filled up to
the 23 bits of the binary Golay code. The code is perfect: every word lies within 3 bits of
exactly one codeword. A segment's keys are the codewords that the segment and its one-bit
changes decode to (6 at most); two segments that differ in up to two bits share one, as the
word one change away from both decodes alike. Pigeonhole: up to 5 errors in three segments
leave at least two of them with 2 errors or fewer each. So fingerprints that differ in at most
5 bits share a pair of keys of two segments, and joining on such pairs, then counting the
differing bits, loses no link.

Equal fingerprints are one class before the join. A group of one key pair is scanned by
vectors; of a group the links sent on are those that join parts not joined yet, never all
pairs. A group above ``GROUP_ROWS`` is cut into blocks, and each pair of blocks is a task's
share. Components are found by Spark rounds over the links (``components.py``).

Defined results: null and wordless texts have fingerprint 0 and link like any other; null ids
count as the largest id of their class; repeated rows each get a row; no rows give no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from abstracta.llm.common import arrow_schema, map_rows, stored, text_or_empty
from abstracta.llm.components import components

SHINGLE_WORDS, DISTANCE = 4, 4
SEGMENTS = (22, 21, 21)
SEED = 42
GROUP_ROWS = 4096
#: Fixed value: a generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator: 0 for codewords."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def leaders() -> np.ndarray:
    """For each of the 2048 syndromes its error of at most 3 bits."""
    bits = [0, *(1 << i for i in range(23))]
    errors = np.array(sorted({a | b | c for a in bits for b in bits for c in bits}), np.int64)
    table = np.zeros(2048, np.int64)
    table[syndromes(errors)] = errors
    return table


def codeword_index(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The 12 message bits of the nearest codeword."""
    return (words ^ table[syndromes(words)]) >> 11


def segment_keys(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A row of 24 codeword numbers per word: its own and those of its one-bit changes."""
    return np.stack([codeword_index(words ^ flip, table) for flip in (0, *(1 << i for i in range(23)))], 1)


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII space
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    reach = min(shingle_words, len(words)) - 1
    spans = zip(starts[: len(words) - reach].tolist(), ends[reach:].tolist())
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - reach)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        octets = hashes[part : part + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(octets.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` per row; ``fp`` is the fingerprint as a signed long."""

    def rows(batch):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            value = fingerprint(text, shingle_words)
            yield doc_id, value - (1 << 64) if value >> 63 else value

    return map_rows(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), rows, "doc_id long, fp long")


def key_pairs(classes: DataFrame) -> DataFrame:
    """``key, fp``: the key pairs of each distinct fingerprint."""
    table, schema = leaders(), arrow_schema("key long, fp long")

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            every = np.asarray(batch.column(0)).astype(np.int64)
            for part in range(0, len(every), 2048):
                fps = every[part : part + 2048]
                words, shift, keys = fps.view(np.uint64), 0, []
                for width in SEGMENTS:
                    segment = (words >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    keys.append(segment_keys(segment.astype(np.int64), table))
                    shift += width
                for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                    both = (keys[i][:, :, None] << 12 | keys[j][:, None, :]).reshape(len(fps), -1)
                    both.sort(1)
                    new = np.ones(both.shape, bool)
                    new[:, 1:] = both[:, 1:] != both[:, :-1]
                    row, _ = np.nonzero(new)
                    columns = pa.array(both[new] | number << 24), pa.array(fps[row])
                    yield pa.RecordBatch.from_arrays(list(columns), schema=schema)

    return classes.select("fp").mapInArrow(task, "key long, fp long")


def spanning(fps: np.ndarray, side: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of at most ``distance`` bits that join the parts of one group.

    ``side`` tells the two blocks of a pair of blocks apart (all 0: one block); two rows of
    the same block are another task's share, unless there is one block only.
    """
    label, links, single = np.arange(len(fps)), [], not side.any()
    for i in range(1, len(fps)):
        near = np.bitwise_count(fps[:i] ^ fps[i]) <= distance
        if not single:
            near &= side[:i] != side[i]
        at = np.flatnonzero(near)
        if len(at):
            parts, first = np.unique(label[at], return_index=True)
            links += [(i, int(at[f])) for f in first if label[at[f]] != label[i]]
            label[np.isin(label, np.append(parts, label[i]))] = parts[0]
    return links


def links(classes: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``a, b``: fingerprints within ``distance`` bits, enough of them to join every component."""
    if distance > 5:
        raise ValueError("key pairs hold up to 5 differing bits")
    one = [F.lit(0).alias(c) for c in ("low", "high", "side")]
    found = stored(_scan(key_pairs(classes).select("key", *one, "fp"), distance, group_rows), "simhash-links")
    # A group too large for one task left its key and its row count instead of links.
    large = found.where("large").select(F.col("a").alias("key")).distinct()
    found = found.where("NOT large").select("a", "b")
    if large.isEmpty():
        return found.distinct()
    rows = key_pairs(classes).join(large, "key")
    counts = rows.groupBy("key").count().select("key", F.ceil(F.col("count") / group_rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    shares = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(block, x) AS low, greatest(block, x) AS high))")
    rows = rows.join(counts, "key").withColumn("block", block).withColumn("share", F.explode(shares))
    side = F.when(F.col("block") == F.col("share.low"), 0).otherwise(1)
    rows = rows.select("key", "share.low", "share.high", side.alias("side"), "fp")
    return found.unionByName(_scan(rows, distance, None).select("a", "b")).distinct()


def _scan(rows: DataFrame, distance: int, most: int | None) -> DataFrame:
    """Links inside each group; of a group of over ``most`` rows only a row with its key."""
    ddl = "a long, b long, large boolean"
    schema = arrow_schema(ddl)

    def task(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []

        def found(rows):
            fps, out = rows[4].view(np.uint64), []
            change = np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)
            bounds = np.concatenate(([0], np.flatnonzero(change) + 1, [rows.shape[1]]))
            sizes = np.diff(bounds)
            over = sizes > (most or len(fps))
            keys = rows[0, bounds[:-1][over]]
            for start, end in zip(bounds[:-1][(sizes > 8) & ~over], bounds[1:][(sizes > 8) & ~over]):
                out += [(start + i, start + j) for i, j in spanning(fps[start:end], rows[3, start:end], distance)]
            left = np.repeat(sizes <= 8, sizes)
            group = np.repeat(np.arange(len(sizes)), sizes)
            pairs = [np.array(out, np.int64).reshape(-1, 2)]
            at = np.flatnonzero(left)
            for lag in range(1, 8):
                at = at[at + lag < len(fps)]
                at = at[group[at] == group[at + lag]]
                near = np.bitwise_count(fps[at] ^ fps[at + lag]) <= distance
                near &= (rows[1, at] == rows[2, at]) | (rows[3, at] != rows[3, at + lag])
                pairs.append(np.stack([at[near], at[near] + lag], 1))
            both = np.concatenate(pairs)
            ends = rows[4][both]
            ends = np.unique(np.stack([ends.min(1), ends.max(1)], 1), axis=0)
            ends = np.concatenate([ends, np.stack([keys, keys], 1)])
            large = np.arange(len(ends)) >= len(ends) - len(keys)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(large)], schema=schema)

        total = 0
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(5)]))
            total += batch.num_rows
            if total >= 1 << 17:
                rows = np.concatenate(held, 1)
                # The last group may go on in the next batch.
                last = np.flatnonzero(np.any(rows[:3] != rows[:3, -1:], axis=0))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield found(rows[:, :cut])
                elif most:
                    rows = rows[:, : most + 1]  # enough to know it as large
                held, total = [rows[:, cut:]], rows.shape[1] - cut
        if total:
            yield found(np.concatenate(held, 1))

    grouped = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return grouped.select("key", "low", "high", "side", "fp").mapInArrow(task, ddl)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``."""
    marked = stored(fingerprints(docs, shingle_words), "simhash-prints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    parts = components(stored(links(classes, distance), "simhash-edges"))
    parts = classes.join(parts, classes["fp"] == parts["node"], "left").select(
        "fp", "least_id", F.coalesce("part", "fp").alias("part")
    )
    # A class stands for all its copies, so this window sees classes, not documents.
    least = parts.groupBy("part").agg(F.min("least_id").alias("component_id"))
    named = parts.join(least, "part").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, distance: int = DISTANCE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    Rows of one id are one document: one of them, the first by text, stays if any stands for
    its component. Rows without an id cannot be named and all stay.
    """
    found = near_duplicates(docs, distance, shingle_words).groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays")
    )
    kept = stored(found.where("stays"), "simhash-kept")
    once = docs.join(kept.where("rows = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    again = kept.where("rows > 1").select("doc_id")
    if not again.isEmpty():
        rows = docs.join(again, "doc_id", "left_semi").select(F.col("doc_id"), F.struct(*docs.columns).alias("row"))
        first = rows.groupBy("doc_id").agg(F.min_by("row", "row.text").alias("row"))
        once = once.unionByName(first.select("row.*"))
    return once.unionByName(docs.where("doc_id IS NULL"))
