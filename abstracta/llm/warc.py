"""WARC writer with a shared Zstandard dictionary, and its reader.

An archive is a table ``file, seq, frame``: the frames of a file, one after another by ``seq``,
are a ``.warc.zst``. The first is a skippable frame that holds the dictionary, every other is
one record, compressed alone, so that records can be read singly and in parallel. The
dictionary is built from a bounded sample of the records to be archived (``SAMPLE_ROWS`` rows,
``SAMPLE_CHARS`` characters of each, drawn by digest).

Defined results: null html is an empty payload; of equal payloads of at least ``LEAST`` bytes
the smallest page id is the response and all others are revisits of it, rows without an id
included (if none of them has an id, all are responses); repeated rows of the smallest id are
responses alike, as a record cannot revisit itself; smaller payloads are all responses; an empty table gives an empty archive; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from abstracta.llm.common import as_batch, arrow_schema, map_rows, stored, text_or_empty

LEAST = 100
#: Repeated digests travel with the tasks up to this size; more meet their rows by digest.
BROADCAST_BYTES = 32 << 20
DICTIONARY_BYTES = 64 * 1024
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 16_384
FILE_BYTES = 1 << 28
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "file long, seq long, frame binary"


def record(page_id, url, payload: bytes, first) -> bytes:
    """One record; ``first`` is the page that a revisit refers to, None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        # Control characters would end the header line.
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if first is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", PROFILE)]
        fields.append(("X-Payload-Length", str(len(payload))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def dictionary(pages: DataFrame) -> bytes:
    """A Zstandard dictionary from a bounded sample; raw sample text where too little is there."""
    sample = (
        pages.where(F.length("html") > 0)
        .select("page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html"))
        .orderBy(F.xxhash64("html"), "page_id")
        .limit(SAMPLE_ROWS)
    )
    samples = [record(r["page_id"], r["url"], r["html"].encode(), None) for r in sample.toLocalIterator()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def with_first(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds ``first``: the page that a row's payload revisits, null for responses.

    The aggregate combines before it shuffles and the join's hot digests are split at run
    time, so a payload that a third of all pages share is no task's alone.
    """
    long = F.octet_length("html") >= least
    pages = pages.withColumn("digest", F.when(long, F.unhex(F.sha2(F.col("html").cast("binary"), 256))))
    groups = pages.where(long).groupBy("digest").agg(F.min("page_id").alias("least_id"), F.count("*").alias("copies"))
    groups = stored(groups.where("copies > 1 AND least_id IS NOT NULL").select("digest", "least_id"), "warc-repeats")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("least_id")), F.col("least_id"))
    if groups.count() * 64 <= BROADCAST_BYTES:
        found = pages.join(F.broadcast(groups), "digest", "left")  # payloads stay where they are
    else:
        # Rows without a digest meet nothing: they are dealt out instead of meeting in one task.
        salt = F.when(F.col("digest").isNull(), F.pmod(F.xxhash64("page_id", "url"), F.lit(1024))).otherwise(0)
        groups = groups.withColumn("salt", F.lit(0).cast("long"))
        found = pages.withColumn("salt", salt).join(groups, ["digest", "salt"], "left")
    return found.select("page_id", "url", "html", first.alias("first"))


def write_archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html`` to the frames of archive files."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_or_empty("html").alias("html"))
    words = dictionary(pages)
    schema = arrow_schema(ARCHIVE)

    def task(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        lead = struct.pack("<II", SKIPPABLE, len(words)) + words
        number, seq, size, frames = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                page_id, url, html, first = row
                if size > FILE_BYTES:
                    number, seq, size = number + 1, 0, 0
                if seq == 0:
                    frames.append((number, 0, lead))
                seq += 1
                frame = packer.compress(record(page_id, url, html.encode(), first))
                size += len(frame)
                frames.append((number, seq, frame))
                if len(frames) >= 512:
                    yield as_batch(frames, schema)
                    frames = []
        if frames:
            yield as_batch(frames, schema)

    return with_first(pages, least).mapInArrow(task, ARCHIVE)


def read_archive(archive: DataFrame) -> DataFrame:
    """Every record: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``.

    Dictionaries come from the leading frames; one writing run has one. For a revisit the
    digest and the length are those that its headers state; its own payload is null.
    """
    leads = [bytes(r["frame"]) for r in archive.where("seq = 0").select("frame").distinct().toLocalIterator()]
    words = {}
    for lead in leads:
        magic, length = struct.unpack("<II", lead[:8])
        if magic != SKIPPABLE or length != len(lead) - 8:
            raise ValueError("damaged dictionary frame")
        data = zstandard.ZstdCompressionDict(lead[8:]) if length else None
        words[data.dict_id() if data else 0] = data
    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    packed = {key: data.as_bytes() if data else b"" for key, data in words.items()}

    def rows(batch):
        readers = {
            key: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
            for key, data in packed.items()
        }
        for frame in batch.column(0).to_pylist():
            fields, payload = parsed(readers[zstandard.get_frame_parameters(frame).dict_id].decompress(frame))
            yield _row(fields, payload)

    return map_rows(archive.where("seq > 0").select("frame"), rows, ddl)


def _page(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else ""
    return int(number) if number else None


def _row(fields: dict[str, str], payload: bytes) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload and digest differ")
        size, own = len(payload), payload
    else:
        size, own = int(fields["X-Payload-Length"]), None
    return (
        _page(fields["WARC-Record-ID"]),
        fields.get("WARC-Target-URI"),
        kind,
        _page(fields.get("WARC-Refers-To")),
        size,
        digest,
        own,
    )
