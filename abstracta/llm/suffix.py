"""Suffix-array dedup: bytes covered by a 100-byte string that starts earlier are removed.

The suffix arrays are sparse: every 100-byte string is anchored at the smallest hash among its
32-byte strings, so equal strings have equal anchors at equal offsets, and about one suffix in
35 is an anchor. Neighbouring strings of one anchor form a segment.

1. Anchored segments meet by anchor, sorted. Of equal segments all but the earliest are
   repeated as a whole. Segments whose anchor has other, different segments may match in part.
2. Those alone go, with their bytes, through a logarithmic family of suffix arrays
   (``SuffixFamily``): each new batch of suffixes, in document order, is sorted, scanned for
   equals in itself and against the existing levels, and added as a level; levels of like size
   are merged. So a batch is compared with everything before it in a few sorted scans.
3. The repeated stretches of each document are joined to its text and cut out.

An anchor that a great many different segments share (a common line in ever different
surroundings) is dealt out by the strings themselves, so that no task holds it alone.

Defined results: null text is empty; the order of documents is by id, null last; rows of one
id are documents of their own, in the order of their texts; overlapping and adjoining stretches
are one; no rows give no rows. Other columns are passed over by ``removed`` and kept by
``deduplicated``, whose texts lose a character that is cut only in part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from abstracta.llm.common import arrow_schema, as_batch, stored, text_or_empty

LENGTH, ANCHOR = 100, 32
#: A part of a text that is hashed at once; longer texts go in overlapping parts.
PART_BYTES = 1 << 19
GROUP_ROWS = 4096
BATCH_SUFFIXES = 1 << 16
SEED = 11
SEGMENTS = "kmer long, segment long, doc long, copy int, start long, n int, known boolean"
#: A repeated stretch, or a segment (with its anchor) that may match in part.
MARKS = "doc long, copy int, start long, n int, kmer long, partial boolean"
LAST = (1 << 63) - 1


class Anchors:
    """Segments of texts by rolling hashes, all in vectors."""

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR) -> None:
        random = np.random.default_rng(SEED)
        self.length, self.anchor = length, anchor
        self.codes = random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(random.integers(1 << 62, 1 << 63)) * 2 + 1
        size = PART_BYTES * 2 + 2 * length
        self.powers, self.inverses = (
            np.append(np.uint64(1), np.full(size, b, np.uint64).cumprod(dtype=np.uint64)) for b in (base, pow(base, -1, 1 << 64))
        )

    @staticmethod
    def mixed(values: np.ndarray) -> np.ndarray:
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return values ^ (values >> np.uint64(29))

    def segments(self, data: np.ndarray, bounds: np.ndarray):
        """Start, strings, anchor hash and content hash of the segments of texts put together."""
        length, size = self.length, len(data)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[:size], dtype=np.uint64, out=sums[1:])
        count = size - self.anchor + 1
        hashes = self.mixed((sums[self.anchor :] - sums[:count]) * self.inverses[:count])
        # The place in the low bits: the leftmost of equal hashes is the smallest.
        low = np.uint64((1 << 23) - 1)
        least, reach, wide = (hashes & ~low) | np.arange(count, dtype=np.uint64), 1, length - self.anchor + 1
        while reach * 2 <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if wide > reach:
            least = np.minimum(least[: reach - wide], least[wide - reach :])
        at = (least & low).astype(np.int64)
        step = np.zeros(size + 1, np.int32)
        starts, ends = bounds[:-1], bounds[1:]
        long = ends - starts >= length
        np.add.at(step, starts[long], 1)
        np.add.at(step, ends[long] - length + 1, -1)
        inside = np.flatnonzero(np.cumsum(step)[: len(at)])
        if not len(inside):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        new = np.ones(len(inside), bool)
        new[1:] = (at[inside[1:]] != at[inside[:-1]]) | (np.diff(inside) != 1)
        first = np.flatnonzero(new)
        start, n = inside[first], np.diff(np.append(first, len(inside)))
        content = (sums[start + n + length - 1] - sums[start]) * self.inverses[start] + n.astype(np.uint64)
        return start, n, hashes[at[start]].view(np.int64), self.mixed(content).view(np.int64)


class SuffixFamily:
    """Sorted arrays of fixed-length strings, in levels that double in size."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Add strings in order of their places; True for each that was there before."""
        order = np.argsort(keys, kind="stable")
        array = keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = array[1:] != array[:-1]
        repeated = np.zeros(len(keys), bool)
        repeated[order[~fresh]] = True
        distinct, places = array[fresh], order[fresh]
        seen = np.zeros(len(distinct), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, distinct), len(level) - 1)
            seen |= level[at] == distinct
        repeated[places[seen]] = True
        # All equals of a string are repeated when it stands in a level.
        known = np.repeat(seen, np.diff(np.append(np.flatnonzero(fresh), len(keys))))
        repeated[order[known]] = True
        if not seen.all():
            self.levels.append(distinct[~seen])
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = np.sort(np.concatenate([self.levels[-1], last]), kind="stable")
        return repeated


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``doc, copy``: the id (null last) and a number among the rows of one id."""
    docs = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    repeated = docs.groupBy("doc").count().where("count > 1").limit(1)
    if repeated.isEmpty():
        return docs.withColumn("copy", F.lit(0))
    order = Window.partitionBy("doc").orderBy("text")
    return docs.withColumn("copy", F.row_number().over(order) - 1)


def segments(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The anchored segments of ``doc, copy, text`` rows.

    A segment that stands earlier in the same batch of rows is known to be repeated. It need
    not meet its anchor, so it is dealt out by its own place: many copies do not pile up.
    """
    schema = arrow_schema(SEGMENTS)

    def task(batches):
        finder = Anchors(length, anchor)

        def found(parts):
            # Parts: document, copy, place in the document, bytes.
            sizes = np.array([len(part[3]) for part in parts])
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            data = np.frombuffer(b"".join(part[3] for part in parts), np.uint8)
            if len(data) < length:
                return None
            start, n, kmer, segment = finder.segments(data, bounds)
            own = np.searchsorted(bounds, start, "right") - 1
            doc, copy, shift = (np.array([part[i] for part in parts], np.int64)[own] for i in range(3))
            start = start - bounds[own] + shift
            order = np.lexsort((start, copy, doc, segment, kmer))
            known = np.zeros(len(order), bool)
            same = (kmer[order[1:]] == kmer[order[:-1]]) & (segment[order[1:]] == segment[order[:-1]])
            known[order[1:][same]] = True
            kmer = np.where(known, doc * 1_000_003 + start, kmer)
            columns = (kmer, segment, doc, copy.astype(np.int32), start, n.astype(np.int32), known)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        for batch in batches:
            parts, held = [], 0
            for doc, copy, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode("utf-8", "surrogatepass")
                for place in range(0, max(1, len(data) - length + 1), PART_BYTES):
                    piece = data[place : place + PART_BYTES + length - 1]
                    if held + len(piece) > PART_BYTES and parts:
                        made = found(parts)
                        if made is not None:
                            yield made
                        parts, held = [], 0
                    parts.append((doc, copy, place, piece))
                    held += len(piece)
            made = found(parts) if parts else None
            if made is not None:
                yield made

    return docs.select("doc", "copy", text_or_empty().alias("text")).mapInArrow(task, SEGMENTS)


def whole_repeats(rows: DataFrame) -> DataFrame:
    """Scan the sorted segments: repeated ones, and the earliest of those that share an anchor."""
    schema = arrow_schema(MARKS)
    columns = ["kmer", "segment", "doc", "copy", "start", "n", "known"]

    def marks(kmer, doc, copy, start, n, partial):
        columns = doc, copy.astype(np.int32), start, n.astype(np.int32), kmer, np.full(len(doc), partial)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def task(batches):
        kmer = segment = None  # of the row before
        pending = None  # the only segment of that anchor so far, sent on when another comes
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(6)])
            known = batch.column(6).to_numpy(zero_copy_only=False)
            yield marks(rows[0][known], *rows[2:, known], False)
            rows = rows[:, ~known]
            if not rows.shape[1]:
                continue
            same = np.append(rows[0, 0] == kmer if kmer is not None else False, rows[0, 1:] == rows[0, :-1])
            equal = same & np.append(rows[1, 0] == segment if kmer is not None else False, rows[1, 1:] == rows[1, :-1])
            yield marks(rows[0][equal], *rows[2:, equal], False)
            first = np.flatnonzero(~equal)
            kmer, segment = rows[0, -1], rows[1, -1]
            if not len(first):
                continue
            if pending is not None and same[first[0]]:
                yield marks(pending[0], *pending[2:], True)
            partial = same[first]
            partial[:-1] |= same[first[1:]]
            some = first[partial]
            yield marks(rows[0][some], *rows[2:, some], True)
            pending = None if partial[-1] else rows[:, first[-1:]]

    dealt = rows.repartition("kmer").sortWithinPartitions("kmer", "segment", "doc", "copy", "start")
    return dealt.select(*columns).mapInArrow(task, MARKS)


STRINGS = "shard long, doc long, copy int, start long, bytes binary"


def strings(docs: DataFrame, partial: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The bytes of the segments that may match in part; a segment of n strings has n + length - 1.

    An anchor of over ``group_rows`` such segments is dealt out string by string.
    """
    schema = arrow_schema(STRINGS)
    many = partial.groupBy("kmer").count().where(F.col("count") > group_rows).select("kmer", F.lit(True).alias("many"))
    wanted = partial.join(many, "kmer", "left")
    # As many entries as a text has segments, at most.
    wanted = wanted.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "n", "kmer", F.coalesce("many", F.lit(False)))).alias("wanted"))

    def task(batches):
        import xxhash

        for batch in batches:
            rows = []
            for doc, copy, text, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = (text or "").encode("utf-8", "surrogatepass")
                for place in places:
                    start, n, kmer, single = place.values()
                    if single:
                        for at in range(start, start + n):
                            key = data[at : at + length]
                            rows.append((xxhash.xxh3_64_intdigest(key) >> 1, doc, copy, at, key))
                    else:
                        rows.append((kmer, doc, copy, start, data[start : start + n + length - 1]))
                if len(rows) > 8192:
                    yield as_batch(rows, schema)
                    rows = []
            yield as_batch(rows, schema)

    # Columns that are not needed come along: pruning them would make another exchange of the texts.
    joined = docs.join(wanted, ["doc", "copy"]).select("doc", "copy", "text", "wanted", "rest")
    return joined.mapInArrow(task, STRINGS)


def partial_repeats(rows: DataFrame, length: int = LENGTH, batch_suffixes: int = BATCH_SUFFIXES) -> DataFrame:
    """Strings that the suffix family of their shard has seen before, as stretches."""
    ddl = "doc long, copy int, start long, n int"
    schema = arrow_schema(ddl)

    def task(batches):
        family, shard, held, suffixes = SuffixFamily(), None, [], 0

        def scanned(rows):
            shards, docs, copies, starts, data = zip(*rows)
            sizes = np.array([len(d) for d in data])
            n = sizes - length + 1
            begin = np.cumsum(sizes) - sizes
            every = np.frombuffer(b"".join(data), np.uint8)
            own = np.repeat(np.arange(len(rows)), n)
            inner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            windows = np.lib.stride_tricks.sliding_window_view(every, length)[begin[own] + inner]
            keys = np.ascontiguousarray(windows).view(f"S{length}").ravel()
            hit = np.flatnonzero(family.add(keys))
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) != 1) | (own[hit[1:]] != own[hit[:-1]])
            at = np.flatnonzero(new)
            count, of = np.diff(np.append(at, len(hit))), own[hit[at]]
            columns = (
                np.array(docs, np.int64)[of],
                np.array(copies, np.int32)[of],
                np.array(starts, np.int64)[of] + inner[hit[at]],
                count.astype(np.int32),
            )
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[0] != shard:
                    # Shards have no strings in common: levels end with them.
                    if suffixes >= batch_suffixes:
                        yield scanned(held)
                        held, suffixes, family = [], 0, SuffixFamily()
                    elif family.levels and held and shard == held[0][0]:
                        yield scanned(held)
                        held, suffixes, family = [], 0, SuffixFamily()
                    elif family.levels and not held:
                        family = SuffixFamily()
                    shard = row[0]
                elif suffixes >= batch_suffixes:
                    yield scanned(held)
                    held, suffixes = [], 0
                held.append(row)
                suffixes += len(row[4]) - length + 1
        if held:
            yield scanned(held)

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "doc", "copy", "start")
    return dealt.select("shard", "doc", "copy", "start", "bytes").mapInArrow(task, ddl)


def joined(stretches, length: int = LENGTH) -> list[list[int]]:
    """Sorted, merged ``[from, to)`` of stretches of n strings."""
    merged: list[list[int]] = []
    for start, n in sorted((s["start"], s["n"]) for s in stretches or []):
        end = start + n + length - 1
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def with_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc, copy, text, rest, stretches``: the repeated parts of each text; ``rest`` holds its other columns.

    The text is dealt out by document once; both joins use that exchange.
    """
    rest = F.struct(*(F.col(c) for c in docs.columns if c != "text"))
    docs = keyed(docs.select("doc_id", "text", rest.alias("rest"))).select("doc", "copy", "text", "rest")
    marks = stored(whole_repeats(segments(docs, length, anchor)), "suffix-marks")
    found = partial_repeats(strings(docs, marks.where("partial"), length), length)
    whole = marks.where("NOT partial").select("doc", "copy", "start", "n")
    stretches = whole.unionByName(found).groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "n")).alias("stretches"))
    return docs.join(stretches, ["doc", "copy"], "left")


def cut(data: bytes, spans: list[list[int]]) -> bytes:
    kept, upto = [], 0
    for start, end in spans:
        kept.append(data[upto:start])
        upto = end
    return b"".join([*kept, data[upto:]])


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``."""
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = arrow_schema(ddl)

    def task(batches):
        for batch in batches:
            rows = []
            for doc_id, text, stretches in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data, spans = (text or "").encode("utf-8", "surrogatepass"), joined(stretches, length)
                lost = sum(end - start for start, end in spans)
                rows.append((doc_id, len(data), lost, len(spans), hashlib.sha256(cut(data, spans)).hexdigest()))
            yield as_batch(rows, schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_repeats(slim, length).select("rest.doc_id", "text", "stretches").mapInArrow(task, ddl)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with the repeated stretches cut out of ``text``; null stays null."""

    def task(batches):
        for batch in batches:
            texts = []
            for text, stretches in zip(batch.column("text").to_pylist(), batch.column("stretches").to_pylist()):
                if text is not None and stretches:
                    text = cut(text.encode(), joined(stretches, length)).decode(errors="ignore")
                texts.append(text)
            place = batch.schema.get_field_index("text")
            batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, pa.string()))
            yield batch.select(["text", "rest"])

    found = with_repeats(docs, length).select("text", "rest", "stretches")
    schema = found.drop("stretches").schema
    columns = [F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns]
    return found.mapInArrow(task, schema).select(*columns)
