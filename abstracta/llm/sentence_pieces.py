"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes one flat array of symbols, cut into words that no piece of the vocabulary can
span. In each round every word's smallest pair rank is found at once (a segmented minimum) and
merged at its leftmost place, in all words together; merged symbols are squeezed out and words
without a pair leave. The library takes the best pair of the whole text next, the leftmost of
equals; words don't touch each other, so their order doesn't matter.

Equal pairs further right in a word are merged in the same round where that can't matter: a
rank is *settled* if no piece of the same or a better rank can be made out of what it makes.
Unsettled ranks (the white space runs of equal score) merge one pair a word and round; a word
of over ``LONG`` symbols that comes to one goes on in a heap, which has the same order.

Each distinct word is merged once a Python worker, as long as ``HELD`` remembered words last.

Defined results: null text is empty (no ids, decodes to the empty text); strings that name
control or byte pieces are ordinary text; characters that the vocabulary lacks become bytes;
repeated rows are encoded alike; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from abstracta.llm.common import text_or_empty

#: Fixed value: the library's sign for a space.
SPACE = "▁"
LONG = 2_048
HELD = 500_000
SLICE_CHARS = 2_000_000
CODE_POINTS = 0x110000
NEVER = np.iinfo(np.int32).max


def vocabulary(path: str | None = None) -> list[tuple[str, float, str]]:
    """``(piece, score, kind)`` by id of a model file; the default is the installed one.

    Only BPE models with byte fallback, the identity normaliser and a leading space are read.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "ﬁ  Ａ "
    if model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or not any(map(model.is_byte, range(len(model)))):
        raise ValueError("wanted: byte fallback, identity normaliser, leading space")

    def kind(i: int) -> str:
        named = {"unknown": model.is_unknown, "control": model.is_control, "byte": model.is_byte, "unused": model.is_unused}
        return next((name for name, test in named.items() if test(i)), "normal")

    pieces = [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(len(model))]
    if any(k == "unused" for _, _, k in pieces):
        raise ValueError("unused pieces are not supported")
    return pieces


@dataclass
class Merges:
    """The vocabulary as arrays. A symbol is a piece's id, or ``offset`` plus a code point."""

    offset: int
    symbol_of: np.ndarray  # of a code point
    keys: np.ndarray  # sorted: left symbol * width + right symbol
    made: np.ndarray  # symbol that the pair makes
    rank: np.ndarray  # 0 is merged first; the last entry stands for no pair
    settled: np.ndarray  # by rank
    joined: np.ndarray  # sorted: first code point * CODE_POINTS + second, neighbours in some piece
    byte_id: np.ndarray
    word: re.Pattern

    @property
    def width(self) -> int:
        return self.offset + CODE_POINTS

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 for none."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1).astype(np.int32)


def merges(pieces: Sequence[tuple[str, float, str]]) -> Merges:
    ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == "normal"}
    offset = len(pieces)
    by_score = {score: r for r, score in enumerate(sorted({pieces[i][1] for i in ids.values()}, reverse=True))}
    rank_of = {piece: by_score[pieces[i][1]] for piece, i in ids.items()}
    settled = np.ones(len(by_score), bool)
    found: list[tuple[int, int, int]] = []
    joined: set[int] = set()

    def symbol(part: str) -> int | None:
        return ids.get(part, offset + ord(part) if len(part) == 1 else None)

    for piece, i in ids.items():
        joined.update(ord(a) * CODE_POINTS + ord(b) for a, b in itertools.pairwise(piece))
        for cut in range(1, len(piece)):
            parts = piece[:cut], piece[cut:]
            left, right = map(symbol, parts)
            if left is None or right is None:
                continue
            found.append((left * (offset + CODE_POINTS) + right, i, rank_of[piece]))
            for part in parts:
                if len(part) > 1 and rank_of[piece] <= rank_of[part]:
                    settled[rank_of[part]] = False
    found.sort()
    keys, made, rank = (np.array(column, np.int64) for column in zip(*found))
    symbol_of = np.arange(CODE_POINTS, dtype=np.int32) + offset
    for piece, i in ids.items():
        if len(piece) == 1:
            symbol_of[ord(piece)] = i
    byte_id = np.zeros(256, np.int32)
    for i, (piece, _, kind) in enumerate(pieces):
        if kind == "byte":
            byte_id[int(piece[1:-1], 16)] = i
    return Merges(
        offset, symbol_of, keys, made.astype(np.int32), np.r_[rank, NEVER].astype(np.int32), settled,
        np.array(sorted(joined), np.int64), byte_id, re.compile(word_pattern(list(ids))),
    )


def word_pattern(pieces: Sequence[str]) -> str:
    """Stretches of text that no piece reaches across, as far as single characters tell.

    A cut may stand in front of a character that follows, inside pieces, only characters of its
    own class: the space sign, signs that are no letters, the line feed. What a vocabulary does
    otherwise is left out of the classes.
    """
    beside = {pair for piece in pieces for pair in itertools.pairwise(piece)}
    if any(b == SPACE != a for a, b in beside):
        return "(?s).+"
    line = "" if any("\n" in pair for pair in beside) else "\n"
    # Signs beyond Latin-1 only where they must be in the class: a small one is matched faster.
    signs = {chr(c) for c in range(256) if not chr(c).isalpha()} - {"\n"}
    while more := {a for a, b in beside if b in signs and not a.isalpha() and a != SPACE} - signs:
        signs |= more
    while drop := {b for a, b in beside if b in signs and a not in signs and a != SPACE}:
        signs -= drop
    some, rest = re.escape("".join(sorted(signs))), re.escape(SPACE + line + "".join(sorted(signs)))
    return rf"{SPACE}*[{some}]+[^{rest}]*|{SPACE}*[^{rest}]+|{SPACE}+" + (r"|\n+" if line else "")


def merged(symbols: np.ndarray, segment: np.ndarray, table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of every segment to the end: symbols and segments, in order.

    ``segment`` has each symbol's segment number, ascending.
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    same = segment[1:] == segment[:-1]
    pair = np.full(len(symbols), -1, np.int32)
    pair[:-1][same] = table.pairs(symbols[:-1][same], symbols[1:][same])
    names, lengths = np.unique_counts(segment)
    while len(names):
        rank = table.rank[pair]
        least = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
        ended = least == NEVER
        tangled = ~ended & (lengths > LONG) & ~table.settled[np.where(ended, 0, least)]
        gone = ended | tangled
        if gone.any():
            for s in np.flatnonzero(tangled):
                rest = one_by_one(symbols[lengths[:s].sum() :][: lengths[s]], table)
                done.append((rest, np.full(len(rest), names[s])))
            done.append((symbols[np.repeat(ended, lengths)], np.repeat(names[ended], lengths[ended])))
            stays = np.repeat(~gone, lengths)
            symbols, pair, rank = symbols[stays], pair[stays], rank[stays]
            names, lengths, least = names[~gone], lengths[~gone], least[~gone]
            if not len(names):
                break
        owner = np.repeat(np.arange(len(names), dtype=np.int32), lengths)
        at = np.flatnonzero(rank == least[owner])
        mine = owner[at]
        first = np.r_[True, mine[1:] != mine[:-1]]
        # Of pairs that overlap, every second one from the left of the run.
        place = np.arange(len(at))
        odd = (place - np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], place, 0))) % 2 == 1
        taken = np.where(table.settled[least[mine]], ~odd, first)
        at, mine = at[taken], mine[taken]
        symbols[at] = table.made[pair[at]]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, pair, owner = symbols[stays], pair[stays], owner[stays]
        lengths -= np.bincount(mine, minlength=len(lengths))
        # The pairs on both sides of what was made; places move left by the merges before them.
        moved = at - np.arange(len(at))
        changed = np.zeros(len(symbols), bool)
        changed[moved] = changed[np.maximum(moved - 1, 0)] = True
        near = np.flatnonzero(changed)
        pair[near] = -1
        near = near[near < len(symbols) - 1]
        near = near[owner[near] == owner[near + 1]]
        pair[near] = table.pairs(symbols[near], symbols[near + 1])
    if not done:
        return symbols, segment
    symbols, segment = map(np.concatenate, zip(*done))
    order = np.argsort(segment, kind="stable")
    return symbols[order], segment[order]


def one_by_one(symbols: np.ndarray, table: Merges) -> np.ndarray:
    """The same order pair by pair: best rank first, the leftmost of equals."""
    held = symbols.tolist()
    after = [*range(1, len(held)), -1]
    before = list(range(-1, len(held) - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] >= 0]
        if lefts:
            found = table.pairs(np.array([held[i] for i in lefts]), np.array([held[after[i]] for i in lefts]))
            for i, pair in zip(lefts, found.tolist()):
                if pair >= 0:
                    heapq.heappush(heap, (int(table.rank[pair]), i, held[i], held[after[i]], int(table.made[pair])))

    offer(list(range(len(held))))
    while heap:
        _, left, a, b, made = heapq.heappop(heap)
        right = after[left]
        if held[left] != a or right < 0 or held[right] != b:
            continue
        held[left], held[right] = made, -1
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        offer([before[left], left])
    return np.array([s for s in held if s >= 0], np.int32)


@dataclass
class Encoder:
    """Encodes texts; remembers the ids of words as one ragged array."""

    table: Merges
    code: dict[str, int] = field(default_factory=dict)
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def words(self, text: str) -> list[str]:
        return self.table.word.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if len(self.ids) > 16 * HELD or len(self.code) > HELD:
            self.code, self.ids, self.ends = {}, self.ids[:0], self.ends[:0]
        spoken = [self.words(text) for text in texts]
        self._learn(list(set(itertools.chain.from_iterable(spoken)).difference(self.code)))
        codes = np.fromiter(map(self.code.__getitem__, itertools.chain.from_iterable(spoken)), np.int64)
        starts = np.r_[0, self.ends]
        lengths = starts[codes + 1] - starts[codes]
        upto = np.cumsum(lengths)
        n = int(upto[-1]) if len(upto) else 0
        ids = self.ids[np.arange(n, dtype=np.int32) + np.repeat((starts[codes] - upto + lengths).astype(np.int32), lengths)]
        return ids, np.diff(np.r_[0, upto][np.cumsum([0, *map(len, spoken)])])

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), list(map(len, words)))
        # Neighbours that stand in no piece side by side can't come together: a segment ends there.
        beside = points[:-1] * CODE_POINTS + points[1:]
        at = np.minimum(np.searchsorted(self.table.joined, beside), len(self.table.joined) - 1)
        linked = (self.table.joined[at] == beside) & (word[1:] == word[:-1])
        segment = np.cumsum(np.r_[True, ~linked]) - 1
        word_of = word[np.flatnonzero(np.r_[True, ~linked])]
        symbols, segment = merged(self.table.symbol_of[points], segment, self.table)
        ids, counts = self._spelled(symbols)
        ends = np.cumsum(np.bincount(word_of[segment], counts, len(words)).astype(np.int64))
        self.code.update(zip(words, range(len(self.ends), len(self.ends) + len(words))))
        self.ends = np.r_[self.ends, len(self.ids) + ends]
        self.ids = np.r_[self.ids, ids]

    def _spelled(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with the bytes of characters that are no piece; and how many each symbol has."""
        unknown = symbols >= self.table.offset
        counts = np.ones(len(symbols), np.int64)
        spelled = [chr(s - self.table.offset).encode() for s in symbols[unknown].tolist()]
        counts[unknown] = list(map(len, spelled))
        ids = np.zeros(counts.sum(), np.int32)
        ids[np.repeat(~unknown, counts)] = symbols[~unknown]
        ids[np.repeat(unknown, counts)] = self.table.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, counts


class Decoder:
    """Ids to text as the library reads them."""

    def __init__(self, pieces: Sequence[tuple[str, float, str]]) -> None:
        unknown = " ⁇ "  # fixed value: how the library shows the unknown piece
        self.text = [
            {"unknown": unknown, "control": "", "byte": None}.get(kind, piece.replace(SPACE, " ")) for piece, _, kind in pieces
        ]
        self.raw = [bytes([int(piece[1:-1], 16)]) if kind == "byte" else b"" for piece, _, kind in pieces]
        spelled = [raw or (text or "").encode() for raw, text in zip(self.raw, self.text)]
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array(list(map(len, spelled)), np.int32)
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.spaced = np.array([text is not None and text.startswith(" ") for text in self.text])
        self.plain = np.array([kind in ("normal", "byte") for _, _, kind in pieces])

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of many lists of ids at once; lists that are no plain text one by one."""
        first = (np.cumsum(counts) - counts)[counts > 0]
        lengths, starts = self.lengths[ids], self.starts[ids]
        led = first[self.spaced[ids[first]]]
        lengths[led] -= 1
        starts[led] += 1
        ends = np.cumsum(lengths, dtype=np.int64)
        body = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]
        offsets = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].astype(np.int32)
        texts = pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(body))
        try:
            texts.validate(full=True)
            if self.plain[ids].all():
                return texts
        except pa.ArrowInvalid:
            pass
        return pa.array([self.decode(part.tolist()) for part in np.split(ids, np.cumsum(counts)[:-1])], pa.string())

    def decode(self, ids: Sequence[int]) -> str:
        """One leading space goes: it was put in front by the encoder."""
        parts: list[str] = []
        at_start = True
        for is_byte, run in itertools.groupby(ids, lambda i: self.text[i] is None):
            if is_byte:
                parts.append(shown(b"".join(self.raw[i] for i in run)))
                at_start = False
                continue
            for i in run:
                text = self.text[i]
                if at_start and text:
                    text, at_start = text.removeprefix(" ") if text != " ⁇ " else text, False
                parts.append(text)
        return "".join(parts)


def shown(raw: bytes) -> str:
    """Bytes as text; every byte that belongs to no character is one replacement sign."""
    parts: list[str] = []
    while True:
        try:
            return "".join([*parts, raw.decode()])
        except UnicodeDecodeError as e:
            parts += [raw[: e.start].decode(), "�"]
            raw = raw[e.start + 1 :]


def slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in lists of bounded size (a longer text alone)."""
    held, size = [], 0
    for text in column:
        text = text.as_py()
        if held and size + len(text) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every row's whole text.

    ``decoded`` is read back from the ids alone. No shuffle; the vocabulary travels as arrays.
    """
    pieces = vocabulary(model)
    shared = docs.sparkSession.sparkContext.broadcast({"pieces": pieces, "merges": vars(merges(pieces))})
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The broadcast value lives as long as the Python worker, and with it what it has learnt.
        known = shared.value
        if "coders" not in known:
            known["coders"] = Encoder(Merges(**known["merges"])), Decoder(known["pieces"])
        encoder, decoder = known["coders"]
        for batch in batches:
            row = 0
            for texts in slices(batch.column(1)):
                ids, counts = encoder.encode(texts)
                offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(row, len(texts)), lists, decoder.decode_all(ids, counts)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                row += len(texts)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(task, "doc_id long, ids array<int>, decoded string")
