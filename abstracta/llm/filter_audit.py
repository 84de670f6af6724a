"""What five filters do to a corpus in every order, and who is to thank for it.

Each document fails some of the filters; the removal game gives a coalition of filters the
documents that at least one of its members removes. That number depends on the documents only
through how many fail exactly which filters, so one pass counts documents by part and failed
set, and all else is computed from at most 32 numbers a part:

* the potential of a coalition (Hart and Mas-Colell) is the mean, over its members, of its
  value per member and of the potentials without one of them, from the empty coalition up. It is kept
  whole, times the factorial of the coalition's size;
* a filter's Shapley value is the grand potential minus the potential without that filter;
* a step of an order is the difference of two coalitions, with and without its filter.

Filters: A under 50 words; B distinct words under 65 in 100; C ``[A-Z]`` over 5 in 100
characters; D holds one of ``#$%&*|``; E the same text as a row of a smaller id, anywhere.

Rows of one text meet by the text's SHA-256. They are counted by part and id before they meet,
so a text of any number of copies sends a row for each part, label and task at most.

Defined results: null text is empty; a null part is the empty string, with which it is one
part; rows without an id are never repeats of others and have no labels; repeated rows are
documents of their own, and of rows of one id and text none repeats the other; a document
without labels has none set, one with several has each that any of them sets; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from abstracta.llm.common import arrow_schema, as_batch, text_or_empty

FILTERS = "ABCDE"
REPEAT = FILTERS.index("E")
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
CAPITALS = bytes(range(65, 91))
SIGNS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))
#: Rows without an id are spread over so many keys of the label join.
SALTS = 1024


def failed(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # bytes are split at the ASCII white space only
    chars = len(text.translate(None, CONTINUED))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_PERCENT * chars) << 2
        | (len(text.translate(None, SIGNS)) < len(text)) << 3
    )


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, failed, digest``: the filters each row fails by itself, and its text's digest."""
    ddl = "doc_id long, part string, failed int, digest binary"
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, source, text in zip(*(batch.column(i) for i in range(3))):
                raw = text.as_py()
                rows.append((doc_id.as_py(), source.as_py(), failed(raw), hashlib.sha256(raw).digest()))
            yield as_batch(rows, schema)

    part_text = F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    return docs.select(F.col("doc_id").cast("long"), part_text, text_or_empty().cast("binary")).mapInArrow(task, ddl)


def failed_sets(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, n, good, toxic``: documents by part and exact set of failed filters."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("marked"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(0)
    rows = flags.withColumn("salt", salt)
    rows = rows.join(marks.withColumn("salt", F.lit(0).cast("long")).withColumnRenamed("marked", "doc_id"), ["doc_id", "salt"], "left")
    kind = ["part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    # By id first, where the join has left the rows; then by text, combined before the exchange.
    rows = rows.select("doc_id", "salt", "digest", *kind)
    named = ["part", "failed", "good", "toxic"]
    by_id = rows.groupBy("doc_id", "salt", "digest", *named).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    texts = by_id.groupBy("digest", *named).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    repeats = F.col("known") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    texts = texts.withColumn("first", first).withColumn("repeats", repeats)
    both = F.explode(
        F.array(
            F.struct(F.col("failed").alias("set"), (F.col("n") - F.col("repeats")).alias("n")),
            F.struct(F.col("failed").bitwiseOR(1 << REPEAT).alias("set"), F.col("repeats").alias("n")),
        )
    ).alias("e")
    counted = texts.select("part", "good", "toxic", both).select("part", "good", "toxic", F.col("e.set").alias("failed"), F.col("e.n").alias("n"))
    having = [F.sum(F.when(F.col(label), F.col("n")).otherwise(0)).alias(label) for label in ("good", "toxic")]
    return counted.where("n > 0").groupBy("part", "failed").agg(F.sum("n").alias("n"), *having)


def coalitions(sets: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, total, value, potential``: arrays over all coalitions, by their bits.

    ``value`` has the documents, good ones and toxic ones that the coalition removes;
    ``potential`` is the removal game's, times the factorial of the coalition's size.
    """
    everyone = 1 << len(filters)
    at = F.explode(F.sequence(F.lit(0), F.lit(everyone - 1))).alias("coalition")
    met = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    sums = [F.sum(F.when(met, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    values = sets.select("part", "failed", "n", "good", "toxic", at).groupBy("part", "coalition").agg(*sums, F.sum("n").alias("total"))
    # 32 rows a part are gathered here.
    game = values.groupBy("part").agg(
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic"))).alias("value"),
    )
    for size in range(len(filters) + 1):
        made = {}
        for coalition in (c for c in range(everyone) if c.bit_count() == size):
            without = [F.col(f"_p{coalition & ~(1 << i)}") for i in range(len(filters)) if coalition >> i & 1]
            own = F.col("value")[coalition]["n"] * math.factorial(max(0, size - 1))
            made[f"_p{coalition}"] = sum(without, own) if size else F.lit(0).cast("long")
        game = game.withColumns(made)
    potential = F.array(*[F.col(f"_p{c}") for c in range(everyone)])
    return game.select("part", "total", "value", potential.alias("potential"))


def audit(sets: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from ``failed_sets``.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, removed before),
    ``unique_fails`` (fail nothing else), ``good_lost`` and ``toxic_lost`` among the removed,
    ``shapley``: the filter's removals summed over all orders.
    """
    n = len(filters)
    grand = (1 << n) - 1
    steps = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"o": "".join(filters[j] for j in order), "s": step, "i": 1 << i, "b": before, "a": before | 1 << i})
            before |= 1 << i
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,i:int,b:int,a:int>>")
    game = coalitions(sets, filters).select("*", F.explode(listed).alias("step"))

    def worth(coalition, what: str = "n"):
        return F.col("value")[coalition][what]

    now, before, alone = F.col("step.a"), F.col("step.b"), F.col("step.i")
    others = F.lit(grand) - alone
    removed = worth(now) - worth(before)
    return game.select(
        "part",
        F.col("step.o").alias("filter_order"),
        F.col("step.s").alias("step"),
        (F.col("total") - worth(now)).alias("kept"),
        removed.alias("removed"),
        (worth(alone) - removed).alias("redundant"),
        (worth(F.lit(grand)) - worth(others)).alias("unique_fails"),
        (worth(now, "good") - worth(before, "good")).alias("good_lost"),
        (worth(now, "toxic") - worth(before, "toxic")).alias("toxic_lost"),
        (F.col("potential")[grand] - F.col("potential")[others] * n).alias("shapley"),
    )
