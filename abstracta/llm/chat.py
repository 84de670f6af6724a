"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio or document. A visitor flattens them in order
into the turn's text, leaving one placeholder for each attachment and recording its reference,
place and expanded token count. Texts may hold the template's own control strings, so every
``<|`` in them gets a backslash between its two characters (and one more where backslashes
stand there already); taking one away gives the text back.

The output is one row per turn: a chunk of the conversation's text, in order. A conversation
of any length is the chunks one after another and is read back as a stream; no group of turns
is ever held whole.

Defined results: null text, role and reference are empty; turns are ordered by turn number
(null first), then role and text; rows without an id are one conversation of their own;
repeated rows are turns of their own; unknown part kinds are formatted as documents; no rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from abstracta.llm.common import as_batch, arrow_schema, map_rows, text_or_empty

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Tokens that an attachment expands to, from its size: patches, seconds, pages.
TOKENS = {
    "image": lambda n: max(1, math.ceil(n / 784)),
    "audio": lambda n: max(1, math.ceil(n * 25)),
    "document": lambda n: max(1, math.ceil(n * 256)),
}
TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.S)
PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


class Visitor:
    """Flattens the parts of one turn."""

    def __init__(self) -> None:
        self.body: list[str] = []
        self.text: list[str] = []
        self.at = 0
        self.attached: list[tuple[str, str, int, int]] = []

    def visit(self, part: dict) -> None:
        kind = part["kind"] or "text"
        getattr(self, f"visit_{kind}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        # Texts side by side are escaped as one: a control string may be cut between two parts.
        self.text.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self.attach("document", part)

    def attach(self, kind: str, part: dict) -> None:
        self.flush()
        units = part["units"]
        tokens = TOKENS[kind](units if units is not None and math.isfinite(units) and units > 0 else 0)
        self.attached.append((kind, part["ref"] or "", self.at, tokens))
        self.put(f"<|{kind}|>")

    def flush(self) -> None:
        self.put(escaped("".join(self.text)))
        self.text = []

    def put(self, piece: str) -> None:
        self.body.append(piece)
        self.at += len(piece)


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, parts`` to one formatted chunk per turn.

    ``loss_from, loss_to`` bound the characters of the chunk under the loss mask (the body of
    an assistant's turn); ``refs, places, tokens`` list the attachments in order.
    """
    ddl = "conv_id long, turn long, chunk string, loss_from long, loss_to long, refs array<string>, kinds array<string>, places array<long>, tokens array<long>"
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("chunk", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())]
        + [(name, pa.list_(pa.string())) for name in ("refs", "kinds")]
        + [(name, pa.list_(pa.int64())) for name in ("places", "tokens")]
    )

    def task(batches):
        for batch in batches:
            rows = []
            for conv, turn, role, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                visitor = Visitor()
                for part in parts or []:
                    if part is not None:
                        visitor.visit(part)
                visitor.flush()
                head = OPEN + escaped_role(role or "") + "\n"
                body = "".join(visitor.body)
                start, end = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
                kinds, refs, places, tokens = map(list, zip(*visitor.attached)) if visitor.attached else ([], [], [], [])
                rows.append((conv, turn, head + body + CLOSE, start, end, refs, kinds, [len(head) + p for p in places], tokens))
            yield as_batch(rows, schema)

    return turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(PARTS)
    ).mapInArrow(task, ddl)


def text_turns(rows: DataFrame) -> DataFrame:
    """Plain rows ``conv_id, turn, role, text`` as turns of one text part."""
    none = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), text_or_empty().alias("text"), none.cast("string").alias("ref"), none.cast("double").alias("units"))
    return rows.select("conv_id", "turn", "role", F.array(part).cast(PARTS).alias("parts"))


def read_chunk(chunk: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns in a formatted text; placeholders stay as they are."""
    return [(unescaped_role(role), unescaped(body)) for role, body in TURN.findall(chunk)]


READ_PARTS = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"
PLACEHOLDER = re.compile(rf"<\|({'|'.join(TOKENS)})\|>")


def read_parts(body: str, refs: list[str], tokens: list[int]) -> list[dict]:
    """The typed parts of a formatted body, in order.

    An escaped text never holds ``<|``, so what looks like a placeholder is one. Texts side by
    side come back as one, empty ones not at all; unknown kinds have become documents.
    """
    parts, at = [], 0
    for n, match in enumerate(PLACEHOLDER.finditer(body)):
        if match.start() > at:
            parts.append({"kind": "text", "text": unescaped(body[at : match.start()]), "ref": None, "tokens": None})
        parts.append({"kind": match[1], "text": None, "ref": refs[n], "tokens": tokens[n]})
        at = match.end()
    if at < len(body):
        parts.append({"kind": "text", "text": unescaped(body[at:]), "ref": None, "tokens": None})
    return parts


def read_turns(chunks: DataFrame) -> DataFrame:
    """Formatted chunks back to ``conv_id, turn, role, parts``, text and attachments told apart."""
    part = pa.struct([("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("parts", pa.list_(part))])

    def task(batches):
        for batch in batches:
            rows = []
            for conv, turn, chunk, refs, tokens in zip(*(batch.column(i).to_pylist() for i in range(5))):
                role, body = TURN.fullmatch(chunk).groups()
                rows.append((conv, turn, unescaped_role(role), read_parts(body, refs, tokens)))
            yield as_batch(rows, schema)

    columns = chunks.select("conv_id", "turn", "chunk", "refs", "tokens")
    return columns.mapInArrow(task, f"conv_id long, turn long, role string, parts {READ_PARTS}")


def read_back(chunks: DataFrame) -> DataFrame:
    """Digest of every conversation, computed from the formatted chunks alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments,
    media_tokens``. Chunks are sorted inside each partition and pass by one at a time.
    """
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, media_tokens long"
    schema = arrow_schema(ddl)

    def task(batches):
        now, state, done = None, None, []
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(5))
            for conv, chunk, start, end, tokens in zip(*columns):
                if state is None or conv != now:
                    if state is not None:
                        done.append(closed(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in read_chunk(chunk):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescaped(chunk[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(chunk)
                state[5] += len(tokens)
                state[6] += sum(tokens)
            if done:
                yield as_batch(done, schema)
                done = []
        if state is not None:
            yield as_batch([closed(now, state)], schema)

    def closed(conv, s):
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6]

    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "chunk")
    return ordered.select("conv_id", "chunk", "loss_from", "loss_to", "tokens").mapInArrow(task, ddl)
