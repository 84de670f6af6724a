"""Edit-aware token counts.

A document is cut into pre-tokens, which a byte-level BPE encodes one by one, so its count is
the sum over pre-tokens. They are kept in a segment tree: leaves hold some dozens of pre-tokens
with their lengths and counts, inner nodes the sums. An edit re-encodes the pre-tokens it
touches and ``CONTEXT`` characters of boundary before it, goes on behind it until the new cuts
meet an old one, and updates the sums on the paths of the leaves it changed. Everything else
keeps its counts.

Defined results: null text is empty (0 tokens); a null list of edits has no edits and null
edits are skipped; positions are characters of the text as the edits before left it, clipped
to it; a null replacement is empty; strings that name special tokens are ordinary text;
repeated rows are counted alike; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from abstracta.llm.common import as_batch, arrow_schema, text_or_empty

LEAF_PIECES = 64
#: A pre-token's match looks at most two characters past its end; one more for safety.
CONTEXT = 3
CACHED = 200_000
#: Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EDITS = "array<struct<start:bigint,end:bigint,text:string>>"


def vocabulary(path: str | None = None) -> dict[bytes, int]:
    """Ranks of a tiktoken file; the default is the installed byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder(dict):
    """Pre-token to token count, remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        count = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            self[piece] = count
        return count


class TokenTree:
    def __init__(self, text: str, encoder: Encoder) -> None:
        self.encoder = encoder
        pieces = encoder.pattern.findall(text)
        self.encoded = len(pieces)
        self._build(pieces, list(map(len, pieces)), list(map(encoder.__getitem__, pieces)))

    def _build(self, pieces, lengths, counts) -> None:
        self.pieces = [pieces[i : i + LEAF_PIECES] for i in range(0, len(pieces), LEAF_PIECES)] or [[]]
        self.lengths = [lengths[i : i + LEAF_PIECES] for i in range(0, len(pieces), LEAF_PIECES)] or [[]]
        self.counts = [counts[i : i + LEAF_PIECES] for i in range(0, len(pieces), LEAF_PIECES)] or [[]]
        self.size = 1 << (len(self.pieces) - 1).bit_length()
        # Node i has the children 2i and 2i + 1; leaf j is node size + j.
        self.chars = self._sums(self.lengths)
        self.tokens = self._sums(self.counts)

    def _sums(self, leaves) -> list[int]:
        level = np.zeros(self.size, np.int64)
        level[: len(leaves)] = list(map(sum, leaves))
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        return [0, *np.concatenate(levels[::-1]).tolist()]

    def _update(self, leaf: int) -> None:
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(self.lengths[leaf]), sum(self.counts[leaf])
        while node > 1:
            node //= 2
            for sums in (self.chars, self.tokens):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.pieces))

    def text(self) -> str:
        return "".join("".join(leaf) for leaf in self.pieces)

    def _find(self, position: int) -> tuple[int, int, int]:
        """Leaf, pre-token and start of the pre-token that holds the character at ``position``."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        leaf = min(node - self.size, len(self.pieces) - 1)
        for piece, length in enumerate(self.lengths[leaf]):
            if position < start + length:
                return leaf, piece, start
            start += length
        return leaf, len(self.lengths[leaf]), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters ``start`` to ``end``."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        first, skip, begin = self._find(max(0, start - CONTEXT))
        # Old pre-tokens from the first touched one on; read as far as the new cuts need.
        leaf, at, old = first, skip, begin
        kept, moved = [], end - start - len(new)
        while old < end:
            if at == len(self.pieces[leaf]):
                leaf, at = leaf + 1, 0
                continue
            kept.append(self.pieces[leaf][at])
            old += self.lengths[leaf][at]
            at += 1
        touched = "".join(kept)
        buffer = touched[: start - begin] + new + touched[end - begin :]
        pieces, done = [], 0
        while True:
            last = leaf == len(self.pieces) - 1 and at == len(self.pieces[leaf])
            for match in self.encoder.pattern.finditer(buffer, done):
                if match.end() + CONTEXT > len(buffer) and not last:
                    break
                pieces.append(match[0])
                done = match.end()
                if done >= len(buffer) and last:
                    break
                # An old cut at the same place behind the edit: all that follows stays.
                if done + begin + moved >= end and self._is_cut(done + begin + moved, leaf, at, old):
                    return self._put(first, skip, pieces, done + begin + moved)
            if last:
                return self._put(first, skip, pieces, self.n_chars)
            if at == len(self.pieces[leaf]):
                leaf, at = leaf + 1, 0
            buffer += "".join(self.pieces[leaf][at:])
            old += sum(self.lengths[leaf][at:])
            at = len(self.pieces[leaf])

    def _is_cut(self, position: int, leaf: int, at: int, old: int) -> bool:
        return position == old or self._find(position)[2] == position

    def _put(self, first: int, skip: int, pieces: list[str], upto: int) -> None:
        """Replace the pre-tokens from ``first, skip`` to the old position ``upto``."""
        leaf, piece, _ = self._find(upto) if upto < self.n_chars else (len(self.pieces) - 1, len(self.pieces[-1]), 0)
        self.encoded += len(pieces)
        made = pieces, list(map(len, pieces)), list(map(self.encoder.__getitem__, pieces))
        for leaves, new in zip((self.pieces, self.lengths, self.counts), made):
            tail = leaves[leaf][piece:]
            leaves[first] = leaves[first][:skip] + new + (tail if leaf == first else [])
            for between in range(first + 1, leaf):
                leaves[between] = []
            if leaf > first:
                leaves[leaf] = tail
        if len(self.pieces[first]) > 4 * LEAF_PIECES:
            # Deal the pre-tokens out anew; nothing is encoded again.
            flat = ([x for leaf in leaves for x in leaf] for leaves in (self.pieces, self.lengths, self.counts))
            self._build(*flat)
        else:
            for changed in range(first, leaf + 1):
                self._update(changed)


RESULT = "doc_id long, n_tokens long, n_edits long, edited_tokens long, edited_chars long, edited_sha256 string, n_pieces long, reencoded long"


def edited_counts(docs: DataFrame, edits: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """Token counts of every row's text before and after its ``edits`` (an array of ``EDITS``).

    ``n_pieces`` counts the pre-tokens after the edits, ``reencoded`` those that the edits had
    to encode. A document's tree lives as long as its row is worked on.
    """
    schema = arrow_schema(RESULT)
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))  # one vocabulary

    def task(batches):
        encoder = Encoder(ranks.value)
        for batch in batches:
            rows = []
            for doc_id, text, changes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tree = TokenTree(text, encoder)
                before, encoded, edited = tree.n_tokens, tree.encoded, 0
                for change in changes or []:
                    if change is not None:
                        tree.edit(change["start"] or 0, change["end"] or 0, change["text"] or "")
                        edited += 1
                digest = hashlib.sha256(tree.text().encode()).hexdigest()
                rows.append((doc_id, before, edited, tree.n_tokens, tree.n_chars, digest, tree.n_pieces, tree.encoded - encoded))
            yield as_batch(rows, schema)

    columns = F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.col(edits).cast(EDITS).alias("edits")
    return docs.select(*columns).mapInArrow(task, RESULT)
