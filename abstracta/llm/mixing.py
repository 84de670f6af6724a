"""Mixing sources to target weights with a time-varying curriculum; native DataFrame code only.

Every source has a weight schedule over training time 0..1, a list of ``(time, weight)`` knots
joined by lines. Its integral is the source's share. Shares are filled like water into vessels
of at most ``repeats`` times a source's size. Inside a source, documents stand in an order
drawn from their id; the source is passed through as often as its target asks, the last pass
ends inside a document. A taken pass over a document has a place in the source's cumulative
demand; inverting the integrated schedule there gives its training position, and rows are
range-sorted by it.

Defined results: a null text has size 0; null sources are one source, last in order; sources
without words get target 0; a null id stands where an empty id text would; repeated rows are
rows of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from abstracta.llm.common import stored

WORDS = r"[^\x20\x09-\x0D]+"
#: Weight schedules, dealt to the sources in turn: a falling, an even and a rising one.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 4.5)))
REPEATS = 3
ROWS_PER_CELL = 4096


def integral(schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))


def inverted(schedule, share: Column) -> Column:
    """The time at which a ``share`` of the schedule's integral is reached."""
    total, area, time = integral(schedule), 0.0, F.lit(schedule[-1][0])
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        slope, piece = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
        need = share * total - area
        if slope:
            at = (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * need)) - w0) / slope + t0
        else:
            at = need / w0 + t0 if w0 else F.lit(t0)
        area += piece
        pieces.append((area, at))
    for upto, at in reversed(pieces):
        time = F.when(share * total <= upto, at).otherwise(time)
    return time


def source_targets(sizes: DataFrame, schedules=SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """``skey, source_size`` to ``skey, source_size, kind, target``: the water-filled shares.

    One row per source; the filling order is a window over that small table.
    """
    kind = (F.row_number().over(Window.orderBy(F.col("skey") == "", "skey")) - 1) % len(schedules)
    weight = F.element_at(F.array([F.lit(float(integral(s))) for s in schedules]), (F.col("kind") + 1).cast("int"))
    frame = sizes.withColumn("kind", kind).withColumn("weight", weight)
    room = (F.col("source_size") * repeats).cast("double")
    order = Window.orderBy(F.col("room") / F.col("weight"), "skey")
    everyone = Window.partitionBy()
    frame = (
        frame.withColumn("room", room)
        .withColumn("all_words", F.sum("source_size").over(everyone).cast("double"))
        .withColumn("filled", F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("thirsty", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("room") * F.col("thirsty") <= (F.col("all_words") - F.col("filled")) * F.col("weight"))
    )
    spare = F.col("all_words") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(everyone)
    takers = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everyone)
    target = F.when(F.col("full"), F.col("room")).otherwise(spare * F.col("weight") / takers)
    return frame.withColumn("target", target).select("skey", "source_size", "kind", "target")


def mix(docs: DataFrame, schedules=SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken, position, positions``.

    ``taken`` counts the words that the mix takes, repeats included; ``positions`` has the
    training position (0 to 1) of every taken pass, the partial last one included, and
    ``position`` is the first of them, null where nothing is taken.

    A hot source is cut into cells of about ``ROWS_PER_CELL`` rows of its drawn order, so its
    running sum is a sum of cells plus a sum inside one cell, never one task's work.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            # Null is the empty key; every other source has a letter in front.
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("skey"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    digits = max(1, math.ceil(math.log(max(1, rows.count() / ROWS_PER_CELL), 16)))
    drawn = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("drawn", drawn).withColumn("cell", F.substring("drawn", 1, digits))

    cells = rows.groupBy("skey", "cell").agg(F.sum("size").alias("cell_size"))
    sources = source_targets(cells.groupBy("skey").agg(F.sum("cell_size").alias("source_size")), schedules, repeats)
    before = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).join(sources, "skey")

    inside = Window.partitionBy("skey", "cell").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["skey", "cell"])
    begin = F.col("offset") + F.col("ahead")
    words = F.round("target").cast("long")
    passes = F.expr("CASE WHEN source_size > 0 THEN words DIV source_size ELSE 0 END")
    placed = placed.withColumn("words", words).withColumn("begin", begin).withColumn("passes", passes)
    number = F.sequence(F.lit(0).cast("long"), F.col("passes"))
    taken = lambda p: F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - p * F.col("source_size") - F.col("begin")))
    share = lambda p, n: (p * F.col("source_size") + F.col("begin") + n / 2) / F.col("words")

    def at(share: Column) -> Column:
        time = F.lit(None).cast("double")
        for number, schedule in enumerate(schedules):
            time = F.when(F.col("kind") == number, inverted(schedule, share)).otherwise(time)
        return time

    shares = F.transform(number, lambda p: F.struct(taken(p).alias("words"), share(p, taken(p)).alias("share")))
    placed = placed.withColumn("shares", F.filter(shares, lambda s: s["words"] > 0))
    placed = placed.withColumn("taken", F.aggregate("shares", F.lit(0).cast("long"), lambda n, s: n + s["words"]))
    placed = placed.withColumn("positions", F.transform("shares", lambda s: at(s["share"])))
    placed = placed.withColumn("position", F.get("positions", F.lit(0)))
    return placed.select("doc_id", "size", "source_size", "target", "taken", "position", "positions")


def training_order(mixed: DataFrame) -> DataFrame:
    """Rows range-sorted by training position, untaken ones last."""
    keys = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def training_passes(mixed: DataFrame) -> DataFrame:
    """``doc_id, pass, words, position``: a row per taken pass, range-sorted by training position.

    Every pass but a row's last takes the whole document.
    """
    passes = mixed.select("doc_id", "size", "taken", F.posexplode("positions").alias("pass", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    passes = passes.select("doc_id", "pass", words.alias("words"), "position")
    keys = [F.col("position"), F.col("doc_id"), F.col("pass"), F.col("words")]
    return passes.repartitionByRange(*keys).sortWithinPartitions(*keys)
