"""Toxicity of texts after noisy-channel deobfuscation.

Three steps, each over all documents: (1) a character language model is counted over the whole
corpus; (2) stretches that look disguised (letters mixed with look-alike signs, letters drawn
out, letters spaced apart) become lattices of what may have been meant, and a Viterbi search
over all contexts, under channel costs and the language model, restores the likeliest reading;
(3) the restored text is scored by the words and word beginnings that mark toxic documents.

A run of letters and signs counts as disguised where a sign stands in front of a letter, or a
digit or money sign behind one; the lattice may leave it as it is. Letters count as spaced apart
with one to three separators between them.

The marks are learnt from at most ``TRAIN_ROWS`` labelled rows: those whose likelihood ratio
stands out against as many tests as there are candidates, the ``MOST_MARKS`` strongest if there
are more. Marks are words of 3 to 40 bytes and their first 4 and 5. A text's log odds are the
prior plus the sum of its distinct marks.

Defined results: null and empty texts score the prior; labels that are null or not 0 or 1 and
ids that are null teach nothing; with no toxic or no clean labels every score is 0; repeated
rows are scored alike and, where labelled, count each; no rows give no rows; only ``text`` is
scored, other columns are passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from abstracta.llm.common import FOLD, arrow_schema, as_batch, shared, stored, text_or_empty

TRAIN_ROWS = 20_000
MOST_MARKS = 5_000
THRESHOLD = 0.7
PURITY = 0.9
LETTERS = 40
ORDER = 4
#: What look-alike signs may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c",
}
SIGNS = "".join(LOOKALIKES)
#: Signs that are no punctuation, so that they also count behind a letter.
STRONG_SIGNS = "".join(c for c in SIGNS if c not in "!|(")
SEPARATORS = " ._*-"
_ANY = rf"(?:[^\W\d_]|[{re.escape(SIGNS)}])"
_APART = rf"{_ANY}(?:[{re.escape(SEPARATORS)}]{{1,3}}{_ANY})"
SPACED = re.compile(rf"{_APART}{{3,}}(?!\w)")
ALL_SPACED = re.compile(rf"{_APART}+")
RUN = re.compile(f"{_ANY}+")
COST_LOOKALIKE, COST_LITERAL, COST_DROPPED, COST_KEPT, COST_SHORTENED, COST_DRAWN, COST_MERGED = 1.0, 4.0, 0.3, 3.0, 0.7, 6.0, 2.0


def letter_codes() -> np.ndarray:
    """Code of every character of the basic plane: 0 no letter, 1-26 a-z, above other letters."""
    codes = np.zeros(0x10000, np.int64)
    for point in range(0x80, 0x10000):
        if chr(point).isalpha():
            codes[point] = 27 + point % (LETTERS - 27)
    codes[97:123] = np.arange(1, 27)
    return codes


def coded(text: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes[np.minimum(points, 0xFFFF)], points


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the ``LETTERS ** ORDER`` character n-grams over all texts; a row per gram and task."""
    schema = arrow_schema("gram int, n long")

    def task(batches):
        codes, total = letter_codes(), np.zeros(LETTERS**ORDER, np.int64)

        def count(texts):
            letters = coded(" ".join(texts).lower(), codes)[0]
            grams, gap = np.append(letters, 0), np.zeros(len(letters) + 1, bool)
            last = grams.copy()
            for back in range(1, ORDER):
                before = np.zeros(len(last), np.int64)
                before[back:] = last[: len(last) - back]
                before[gap] = 0  # letters behind a gap are another word's
                gap |= before == 0
                grams += before * LETTERS**back
            return np.bincount(grams, minlength=len(total))

        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                held.append(text)
                size += len(text)
                if size > 1 << 21:
                    total += count(held)
                    held, size = [], 0
            total += count(held)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], schema=schema)

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(task, "gram int, n long")
    table = counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most LETTERS ** ORDER rows
    counts = np.zeros(LETTERS**ORDER, np.float64)
    counts[np.asarray(table["gram"].combine_chunks())] = np.asarray(table["n"].combine_chunks())
    return counts


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """Minus log probability of a letter after the three before it, smoothed by shorter contexts."""
    levels = [counts.reshape([LETTERS] * ORDER)]
    while levels[-1].ndim > 1:
        levels.append(levels[-1].sum(0))
    chance = np.full(LETTERS, 1 / LETTERS)
    for level in levels[::-1]:
        chance = (level + 5.0 * chance) / (level.sum(-1, keepdims=True) + 5.0)
    return -np.log(chance).astype(np.float32).ravel()


class Decoder:
    """Viterbi search over character lattices; readings of short stretches are remembered."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs, self.codes = costs, letter_codes()
        self.signs = np.zeros(0x10000, bool)
        self.signs[[ord(c) for c in SIGNS]] = True
        self.strong = np.zeros(0x10000, bool)
        self.strong[[ord(c) for c in STRONG_SIGNS]] = True
        self.gaps = np.zeros(0x10000, bool)
        self.gaps[[*map(ord, SEPARATORS), 9, 10, 13]] = True
        self.known: dict[str, str] = {}

    def restored(self, text: str) -> str:
        """The text in lower case, disguised stretches replaced by their likeliest reading."""
        text, parts, upto = text.lower(), [], 0
        for place, spaced in self._suspicious(text):
            if place < upto:
                continue
            start = place
            if not spaced:
                while start > upto and self._any(text[start - 1]):
                    start -= 1
            match = (SPACED if spaced else RUN).match(text, start)
            if match:
                parts += text[upto:start], self._reading(match[0])
                upto = match.end()
        return "".join([*parts, text[upto:]])

    def _any(self, sign: str) -> bool:
        point = min(ord(sign), 0xFFFF)
        return self.codes[point] > 0 or bool(self.signs[point])

    def _suspicious(self, text: str) -> list[tuple[int, bool]]:
        """Places of disguise, and whether letters are spaced apart there; found by vectors."""
        letters, points = coded(f" {text}   ", self.codes)
        points = np.minimum(points, 0xFFFF)
        letter, sign = letters > 0, self.signs[points]
        size = len(text)
        one, two, three = (slice(i, size + i) for i in (1, 2, 3))
        drawn = letter[one] & (points[one] == points[two]) & (points[two] == points[three])
        # A sign counts in front of a letter, with a letter or sign before it or a letter behind.
        mixed = sign[one] & letter[two] & (letter[:size] | sign[:size] | letter[three])
        mixed |= self.strong[points[one]] & letter[:size]
        single = (letter | sign)[one] & self.gaps[points[two]] & self.gaps[points[:size]]
        # Four letters alone within the room that three separators between them can take.
        upto = np.r_[0, np.cumsum(single)]
        run = single & (upto[np.minimum(np.arange(size) + 13, size)] - upto[:-1] >= 4)
        places = np.flatnonzero(drawn | mixed | run)
        return list(zip(places.tolist(), run[places].tolist()))

    def _reading(self, stretch: str) -> str:
        if len(stretch) > 64:
            return self._decode(stretch)  # too long to be met again
        if stretch not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[stretch] = self._decode(stretch)
        return self.known[stretch]

    def lattice(self, stretch: str) -> list[list[tuple[str, float]]]:
        """Per place of the stretch the characters that may have been meant, with their costs."""
        spaced = ALL_SPACED.fullmatch(stretch) is not None
        places, at = [], 0
        while at < len(stretch):
            sign, run = stretch[at], 1
            while at + run < len(stretch) and stretch[at + run] == sign:
                run += 1
            if spaced and sign in SEPARATORS:
                # One separator parts letters, several are more likely to part words.
                places.append([("", COST_DROPPED), (sign, COST_KEPT)] if run == 1 else [(" ", COST_DROPPED), ("", COST_KEPT)])
            elif run > 2 and sign.isalpha():
                places.append([(sign, COST_SHORTENED), (sign * 2, COST_SHORTENED), (sign * run, COST_DRAWN)])
            elif sign in LOOKALIKES:
                meant = [(c, COST_LOOKALIKE) for c in LOOKALIKES[sign]] + [(sign, COST_LITERAL)]
                places += [meant + [("", COST_MERGED)] * (i > 0) for i in range(run)]
            else:
                places += [[(sign, 0.0)]] * run
            at += run
        return places

    def _decode(self, stretch: str) -> str:
        """The cheapest reading. A path is known by its last three letters, all of which are kept;
        its pieces are a chain that paths share as far as they agree."""
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for place in self.lattice(stretch):
            grown: dict[int, tuple[float, tuple | None]] = {}
            for context, (cost, chain) in paths.items():
                for piece, channel in place:
                    now, spoken = self.spoken(context, piece)
                    total = cost + channel + spoken
                    if now not in grown or total < grown[now][0]:
                        grown[now] = total, (piece, chain)
            paths = grown
        _, chain = min((cost + float(self.costs[context * LETTERS]), i, chain) for i, (context, (cost, chain)) in enumerate(paths.items()))[1:]
        pieces = []
        while chain:
            pieces.append(chain[0])
            chain = chain[1]
        return "".join(reversed(pieces))

    def spoken(self, context: int, piece: str) -> tuple[int, float]:
        """The context behind a piece, and what the language model asks for it.

        Of a drawn-out letter the first four are counted.
        """
        total = 0.0
        for letter in piece[:4]:
            code = int(self.codes[min(ord(letter), 0xFFFF)])
            gram = context * LETTERS + code
            total += float(self.costs[gram])
            context = gram % LETTERS ** (ORDER - 1) if code else 0
        return context, total


def marks(restored: str) -> set[bytes]:
    """Distinct words and word beginnings (with a star) of a restored text."""
    words = {w for w in restored.encode("utf-8", "surrogatepass").translate(FOLD).split() if 3 <= len(w) <= 40}
    starts = {w[:4] + b"*" for w in words if len(w) > 4}
    return words | starts | {w[:5] + b"*" for w in words if len(w) > 5}


@dataclass
class Model:
    costs: np.ndarray
    prior: float
    weights: dict[bytes, float]

    def scorer(self):
        decoder, weights, known = Decoder(self.costs), self.weights, frozenset(self.weights)

        def score(text: str) -> float:
            odds = self.prior + sum(weights[m] for m in sorted(known & marks(decoder.restored(text))))
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))

        return score


def fit(docs: DataFrame, labels: DataFrame, taught: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled rows for which ``taught``, a condition on ``doc_id``, holds."""
    spark = docs.sparkSession
    costs = letter_costs(gram_counts(docs))
    letters = spark.sparkContext.broadcast(costs)  # LETTERS ** ORDER numbers
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    told = told.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & taught)
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(F.broadcast(told), "doc_id")
    rows = rows.dropDuplicates(["text", "toxic"])  # copies are one example

    def task(batches):
        decoder = Decoder(letters.value)
        schema = arrow_schema("mark binary, toxic long, n long")
        for batch in batches:
            toxic, every = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = marks(decoder.restored(text))
                found.add(b"")  # counts the rows themselves
                every.update(found)
                if label:
                    toxic.update(found)
            yield as_batch([(m, toxic[m], n) for m, n in every.items()], schema)

    counted = rows.select("text", "toxic").mapInArrow(task, "mark binary, toxic long, n long")
    counted = counted.groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where("n > 1 OR mark = X''")
    counted = stored(counted, "toxic-marks")
    whole = counted.where("mark = X''").head()
    bad, every = (whole["toxic"], whole["n"]) if whole else (0, 0)
    if bad == 0 or bad == every:
        return Model(costs, -50.0, {})
    clean = every - bad
    share = bad / every
    # Log likelihood of the split between toxic and clean rows against chance.
    t, n = F.col("toxic").cast("double"), F.col("n").cast("double")
    ratio = t * F.log(t / n / share) + F.when(n > t, (n - t) * F.log((n - t) / n / (1 - share))).otherwise(0.0)
    found = counted.where((F.col("mark") != F.expr("X''")) & (t / n >= PURITY))
    tests = max(2, counted.count())
    bar = math.log(tests) + 2
    strong = found.withColumn("ratio", ratio).where(F.col("ratio") >= bar)
    top = strong.orderBy(F.col("ratio").desc(), "mark").limit(MOST_MARKS).collect()
    weights = {}
    for row in top:
        weight = math.log((row["toxic"] + 0.5) / (bad + 1)) - math.log((row["n"] - row["toxic"] + 0.5) / (clean + 1))
        # Near copies of one text are not independent: a mark just over the bar counts for less.
        weights[bytes(row["mark"])] = weight * row["ratio"] / (row["ratio"] + 2 * bar)
    return Model(costs, math.log(share / (1 - share)), weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row."""
    known = shared(docs.sparkSession, model)  # at most MOST_MARKS words and the letter costs

    def task(batches):
        schema, scored = arrow_schema("doc_id long, score double"), known().scorer()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield as_batch(list(zip(batch.column(0).to_pylist(), map(scored, texts))), schema)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(task, "doc_id long, score double")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are."""
    known = shared(docs.sparkSession, model)

    def task(batches):
        scored = known().scorer()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([scored(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
