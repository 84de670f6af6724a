"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words (lower case, parted by anything but letters and digits). An item
of n words is found where a passage of a document is within ``share * n`` word edits of it.

Windows of an item's length start at every word. Those that hold too few of the benchmark's
words cannot be within the distance and are left out (each kept word of a passage is a word of
its item, as often as there). The rest, and the items, take CGK walks: a random function of step and word says
whether the walk repeats the word or goes on, which turns few edits into few differing places
of equally long outputs. A table of the LSH samples some places of one walk's output; windows
that agree with an item in one table are candidates. Walks over long texts drift apart, so an
item of over ``CHUNK_WORDS`` words is looked for by chunks of about that length: if the whole is
within its share of edits, some chunk is within the same share of its own words, or their sum
would be larger. With ``WALKS`` walks of ``TABLES`` tables the tests measure the recall at the
largest distance, by length and kind of edit. Candidates are verified exactly by the
bit-parallel edit distance of the whole item over the region around them.

Items of so few words that their share allows no edit (under 5 at 0.2) are sought by equality:
every window equal to them agrees in all tables. ``least_words`` leaves short ones out.

Items travel with the tasks in blocks of at most ``BLOCK_BYTES`` of text; documents never move.

Defined results: null texts hold nothing; items of under ``least_words`` words (1 for all but
the empty ones; the default ``LEAST_WORDS`` is there because one or two words are in half the
documents), null ones and those without an id take no part; of a repeated item id every row counts and the smallest
distance in its block is told (rows of one id are dealt to one block); rows without a document id are reported with a null id; repeated rows are
reported each; an empty table on either side finds nothing; other columns are ignored.
"""

from __future__ import annotations

from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from abstracta.llm.common import FOLD, arrow_schema, as_batch, shared, text_or_empty

SHARE = 0.2
LEAST_WORDS = 5
WALKS, TABLES, PLACES = 6, 10, 2
STRETCH = 3
CHUNK_WORDS = 60
BAND = 1.12
BLOCK_BYTES = 4 << 20
#: Windows that are looked at together, and their words at most.
WINDOWS, WINDOW_WORDS = 1 << 15, 1 << 22
SEED = 7
FOUND = "doc_id long, item_id long, distance long, item_words long, last_word long"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def edit_matches(item: list, region: list) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to any stretch of ``region``, and its last place."""
    masks: dict = {}
    for place, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << place
    full, high = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, distance = full, 0, len(item)
    best, where = distance, -1
    for place, word in enumerate(region):
        same = masks.get(word, 0)
        cross = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(cross | up)), up & cross
        distance += bool(more & high) - bool(less & high)
        more, less = more << 1 & full, less << 1 & full  # a stretch may start anywhere
        up, down = less | (full & ~((same | down) | more)), more & (same | down)
        if distance < best:
            best, where = distance, place
    return best, where


class Index:
    """Items of one block, their words numbered and the walks of their chunks in tables."""

    def __init__(self, items: list[tuple[int, str]], share: float, least_words: int = LEAST_WORDS) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int], int]] = []
        self.chunks: list[tuple[int, int, list[int]]] = []  # item, first word, words
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= max(1, least_words):
                numbered = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
                parts = -(-len(words) // CHUNK_WORDS)
                cuts = [len(words) * i // parts for i in range(parts + 1)]
                self.chunks += [(len(self.items), a, numbered[a:b]) for a, b in pairwise(cuts)]
                self.items.append((item_id, numbered, int(share * len(words) + 1e-9)))
        self.lengths: dict[int, list[int]] = {}
        for number, (_, _, words) in enumerate(self.chunks):
            self.lengths.setdefault(len(words), []).append(number)
        self.bands: list[list[int]] = []
        for length in sorted(self.lengths):
            if not self.bands or length > BAND * self.bands[-1][0] + 1:
                self.bands.append([])
            self.bands[-1].append(length)
        self.tables = {}
        for length, numbers in self.lengths.items():
            words = np.array([self.chunks[n][2] for n in numbers], np.int64)
            keys = lsh_keys(words.ravel(), np.arange(len(numbers)) * length, length)
            allowed = int(share * length + 1e-9)
            vocabulary = np.zeros(len(self.numbers) + 1, bool)
            vocabulary[words.ravel()] = True
            # How often an item of this length holds a word at most.
            most = np.zeros(len(self.numbers) + 1, np.int16)
            for row in words:
                word, times = np.unique(row, return_counts=True)
                most[word] = np.maximum(most[word], times)
            order = np.argsort(keys, axis=1)
            self.tables[length] = allowed, vocabulary, most, np.take_along_axis(keys, order, 1), np.array(numbers)[order]


def lsh_keys(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Keys per table and window: the sampled places of the CGK walks over ``length`` words."""
    random = np.random.default_rng([SEED, length])
    steps = STRETCH * length
    keys = np.empty((WALKS * TABLES, len(starts)), np.uint64)
    for walk in range(WALKS):
        mix = random.integers(1, 1 << 63, steps, np.uint64) | np.uint64(1)
        add = random.integers(0, 1 << 63, steps, np.uint64)
        # Late places are mostly padding: a walk needs about two steps a word.
        places = random.integers(0, 2 * length, (TABLES, PLACES))
        taken: dict[int, list[int]] = {}
        for table in range(TABLES):
            for place in places[table]:
                taken.setdefault(int(place), []).append(table)
        held = np.zeros((TABLES, len(starts)), np.uint64)
        held += np.arange(1, TABLES + 1, dtype=np.uint64)[:, None] * np.uint64(walk + 1)
        at = np.zeros(len(starts), np.int64)
        for step in range(max(taken) + 1):
            inside = at < length
            here = words[starts + np.minimum(at, length - 1)].astype(np.uint64)
            here = np.where(inside, here + np.uint64(2), np.uint64(0))
            for table in taken.get(step, ()):
                held[table] = (held[table] ^ here) * np.uint64(0x9E3779B97F4A7C15)
                held[table] ^= held[table] >> np.uint64(29)
            on = (here * mix[step] + add[step]) >> np.uint64(63)
            at += on.astype(np.int64)
        keys[walk * TABLES : (walk + 1) * TABLES] = held
    return keys


def distinct(windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for all equal ones, and which of them each row equals."""
    random = np.random.default_rng([SEED, length, 1])
    mix = random.integers(1, 1 << 63, (2, length), np.uint64) | np.uint64(1)
    hashes = ((windows.astype(np.uint64) + np.uint64(3)) * mix[0] ^ mix[1]) * mix[1]
    hashes = (hashes ^ (hashes >> np.uint64(31))).sum(1, dtype=np.uint64)
    _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
    return first, same


def enough_shared(windows: np.ndarray, most: np.ndarray, least: int) -> np.ndarray:
    """Rows that can share ``least`` words with an item, each word as often as one holds it."""
    ordered = np.sort(windows, axis=1)
    places = np.arange(windows.shape[1])
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    nth = places - np.maximum.accumulate(np.where(new, places, 0), axis=1)
    return (nth < most[ordered]).sum(1) >= least


def matches(index: Index, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """Per text the items in it: ``item_id, distance, item words, last word``."""
    get, unknown = index.numbers.get, len(index.numbers)
    parts, bounds = [], [0]
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter(map(get, words, repeat(unknown)), np.int32, len(words)))
        bounds.append(bounds[-1] + len(words))
    total, edges = bounds[-1], np.array(bounds)
    longest = max(index.lengths, default=0)
    words = np.concatenate([*parts, np.full(longest, unknown, np.int32)])
    known = np.concatenate(([0], np.cumsum(words != unknown, dtype=np.int32)))
    regions: dict[tuple[int, int], list[list[int]]] = {}
    for band in index.bands:
        # What the first words of any window of the band must hold at least.
        short, slack = band[0], max(index.tables[length][0] for length in band)
        starts = np.flatnonzero(known[short : short + total] - known[:total] >= short - slack)
        for length in band if len(starts) else ():
            allowed, vocabulary, most, tables, numbers = index.tables[length]
            likely = starts[known[starts + length] - known[starts] >= length - allowed]
            step = min(WINDOWS, max(1, WINDOW_WORDS // length))
            for part in range(0, len(likely), step):
                some = likely[part : part + step]
                held = np.zeros(len(some), np.int32)
                for place in range(length):
                    held += vocabulary[words[some + place]]
                some = some[held >= length - allowed]
                if not len(some):
                    continue
                # Runs of repeated lines give the same window many times: it is walked once.
                windows = words[some[:, None] + np.arange(length)]
                first, same = distinct(windows, length)
                good = np.flatnonzero(enough_shared(windows[first], most, length - allowed))
                if not len(good):
                    continue
                keys = lsh_keys(windows[first[good]].ravel().astype(np.int64), np.arange(len(good)) * length, length)
                pairs = set()
                for table in range(len(keys)):
                    low = np.searchsorted(tables[table], keys[table], "left")
                    high = np.searchsorted(tables[table], keys[table], "right")
                    for hit in np.flatnonzero(high > low):
                        pairs.update((int(hit), int(n)) for n in numbers[table, low[hit] : high[hit]])
                for hit, chunk in pairs:
                    at = some[same == good[hit]]
                    docs = np.searchsorted(edges, at, "right") - 1
                    number, offset, _ = index.chunks[chunk]
                    _, item, slack = index.items[number]
                    # Where the whole item may lie: the chunk and what stands before it may have shifted.
                    begin, upto = at - offset - slack - allowed, at - offset + len(item) + slack + allowed
                    spans = np.maximum(edges[docs], begin), np.minimum(edges[docs + 1], upto)
                    for doc, start, end in zip(docs.tolist(), spans[0].tolist(), spans[1].tolist()):
                        regions.setdefault((doc, number), []).append([start, end])
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for (doc, number), spans in regions.items():
        item_id, item, allowed = index.items[number]
        best = None
        for start, end in _joined(spans):
            distance, place = edit_matches(item, words[start:end].tolist())
            if distance <= allowed and (best is None or distance < best[0]):
                best = distance, start + place - bounds[doc]
        if best:
            found[doc].append((item_id, best[0], len(item), best[1]))
    return [_once(rows) for rows in found]


def _joined(spans: list[list[int]]):
    spans.sort()
    now = spans[0]
    for span in spans[1:]:
        if span[0] <= now[1]:
            now[1] = max(now[1], span[1])
        else:
            yield now
            now = span
    yield now


def _once(rows: list[tuple]) -> list[tuple]:
    best: dict = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        best.setdefault(row[0], row)
    return list(best.values())


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark in pieces of about ``block_bytes`` of text, each small enough to travel."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = -(-total // block_bytes)
    for number in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        yield [(r["item_id"], r["text"]) for r in rows.toLocalIterator()]


def _tasks(index: Index, batches, text_column: str):
    """Batches cut into pieces of bounded text, with the matches of each row."""
    for batch in batches:
        texts = batch.column(text_column).to_pylist()
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (size < 1 << 22 or end == start):
                size += len(texts[end] or "")
                end += 1
            yield batch.slice(start, end - start), matches(index, [t or "" for t in texts[start:end]])
            start = end


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, item_id, distance, item_words, last_word`` of every item found in a document."""
    spark, schema = docs.sparkSession, arrow_schema(FOUND)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    result = spark.createDataFrame([], FOUND)
    for items in item_blocks(benchmark):
        index = shared(spark, Index(items, share, least_words))

        def task(batches, index=index):
            for batch, found in _tasks(index(), batches, "text"):
                ids = batch.column("doc_id").to_pylist()
                yield as_batch([(i, *row) for i, mine in zip(ids, found) for row in mine], schema)

        result = result.unionByName(rows.mapInArrow(task, FOUND))
    return result


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are."""
    spark = docs.sparkSession
    for items in item_blocks(benchmark):
        index = shared(spark, Index(items, share, least_words))

        def task(batches, index=index):
            for batch, found in _tasks(index(), batches, "text"):
                yield batch.filter(pa.array([not mine for mine in found], pa.bool_()))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
