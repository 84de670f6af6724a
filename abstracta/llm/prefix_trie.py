"""Prefix trie of conversations with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns. Its key is made of 128 bits over the turns and
their places, a running exclusive or along the conversation, so that a conversation's rows
need not stand in one task: they are numbered and summed up in ranges, which are then shifted
by what the ranges before hold.

Totals of subtrees come from rounds of joins, whose number grows with the logarithm of the
trie's size and not with its depth. In every round

* *compress* takes nodes out of unary chains (of two neighbours only the one whose depth has
  fewer trailing zeros, then the smaller hash): the only child goes to the grandparent and
  keeps on its edge what it passed;
* *rake* takes all leaves: a leaf's weight is its total and goes, with its edge, to its parent.

When the root is left, the compressed nodes are put back in reverse rounds: a node's total is
its weight, its child's edge of then and its child's total. All joins but the one that looks up
parents have unique keys on both sides; a node with any number of children is a sum, combined
before the exchange. Each round is written to the shared folder.

Defined results: rows without a conversation are left out; null role and text are empty; turns
stand in order of turn number (null first), role and digest of the text, repeated rows are turns
of their own; ids that occur have a rebuilt conversation even where it has no turns; no rows
give no rows, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from abstracta.llm.common import arrow_schema, as_batch, stored, text_or_empty

WORDS = r"[^\x20\x09-\x0D]+"
GROUP, SHARED = 20, 4
#: Places of a conversation, or ids of a node's ends, that are worked on together.
RANGE = 4096


def numbered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` to ``conv_id, place, said, words``: places from 1, digest of
    role and text. The rows are dealt by ranges of the whole order, which cut a long conversation."""
    text, role = text_or_empty(), text_or_empty("role")
    said = F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256).alias("said")
    words = F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.sha2(text, 256).alias("by"), said, words
    )
    order = ["turn", "role", "by"]
    ranged = stored(turns.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "turns")
    inside = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # Only a range's first conversation can have begun before it: one row for each range.
    cut = counts.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select("conv_id", "range", "before")
    placed = ranged.withColumn("place", inside.cast("long")).join(F.broadcast(cut), ["conv_id", "range"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "said", "words")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def grafted(turns: DataFrame) -> DataFrame:
    """Rebuild every conversation on the first turns of its group's conversation.

    Of ``numbered`` turns: the first h of conversation ``c - c % 20``, then the own ones after
    the first h. Result: ``conv_id, place, said, words, length``, and a row with place 0 for
    each conversation.
    """
    turns = stored(turns, "numbered")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    head = F.slice(F.array_sort(F.collect_list(F.struct("place", "said", "words"))), 1, SHARED)  # below SHARED turns
    heads = turns.where((base == F.col("conv_id")) & (F.col("place") < SHARED)).groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumns({"base": base, "h": shared_turns(F.col("conv_id"))}).join(heads, "base", "left")
    taken = F.when(F.col("head").isNull(), F.array().cast("array<struct<place:bigint,said:string,words:bigint>>"))
    taken = taken.otherwise(F.slice("head", F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("taken", taken).withColumn("m", F.size("taken").cast("long"))
    convs = stored(convs.select("conv_id", "h", "m", "taken", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    lent = convs.select("conv_id", "length", F.inline("taken")).select("conv_id", "place", "said", "words", "length")
    own = turns.join(convs.select("conv_id", "h", "m", "length"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "said", "words", "length")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("said"), F.lit(0).cast("long").alias("words"), "length")
    return lent.unionByName(own).unionByName(root)


def keyed(paths: DataFrame) -> DataFrame:
    """Add ``node`` and ``parent`` keys to ``conv_id, place, said, words, length``."""
    own = [F.xxhash64("place", "said").alias("a"), F.xxhash64("said", "place").alias("b")]
    rows = paths.select("*", F.floor(F.col("place") / RANGE).alias("range"), *[F.when(F.col("place") > 0, x).otherwise(0).alias(n) for x, n in zip(own, "ab")])
    upto = Window.partitionBy("conv_id", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{n}_in": F.expr(f"bit_xor({n})").over(upto) for n in "ab"})
    sums = rows.where(F.col("length") >= RANGE).groupBy("conv_id", "range").agg(*[F.expr(f"bit_xor({n})").alias(n) for n in "ab"])
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "range", *[F.expr(f"bit_xor({n})").over(earlier).alias(f"{n}_before") for n in "ab"])
    rows = rows.join(sums, ["conv_id", "range"], "left")
    node = {n: F.col(f"{n}_in").bitwiseXOR(F.coalesce(f"{n}_before", F.lit(0))) for n in "ab"}
    parent = F.struct(*[node[n].bitwiseXOR(F.col(n)).alias(n) for n in "ab"])
    return rows.select(
        "conv_id", "place", "words", "length", F.struct(*[node[n].alias(n) for n in "ab"]).alias("node"),
        F.when(F.col("place") > 0, parent).alias("parent"),
    )


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``id, parent, depth, w1, w2`` to ``id, t1, t2``: sums of both weights over each subtree.

    ``parent`` is null at the root of a tree; there may be several trees.
    """
    weights = ("w1", "w2")
    edges = {f"e{w[1]}": F.lit(0).cast("long") for w in weights}
    alive, rounds = tree.select("id", "parent", "depth", *weights).withColumns(edges), []
    while True:
        kids = alive.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids"), F.min("id").alias("child"))
        known = alive.join(kids.withColumnRenamed("parent", "id"), "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
        known = stored(known, "tree")
        after = stored(_compressed(known), "contracted")
        rounds.append(after)
        stays = after.where("not spliced and kids > 0")
        if stays.isEmpty():
            break
        raked = after.where("kids = 0 and parent is not null").groupBy("parent").agg(
            *[F.sum(F.col(w) + F.col(f"e{w[1]}")).alias(f"more_{w}") for w in weights]
        )
        alive = stays.join(raked.withColumnRenamed("parent", "id"), "id", "left").select(
            "id", "parent", "depth", *[(F.col(w) + F.coalesce(f"more_{w}", F.lit(0))).alias(w) for w in weights], "e1", "e2"
        )
    return _expanded(rounds)


def _compressed(tree: DataFrame) -> DataFrame:
    """Splice out of every unary chain the nodes that come before both neighbours.

    Adds ``spliced``, and to a spliced node its child's edge so far (``c1, c2``); the child gets
    the new parent and edge.
    """
    # Trailing zeros of the depth: in a fresh chain every second node goes.
    low = F.col("depth").bitwiseAND(-F.col("depth"))
    unary = tree.where("kids = 1 and parent is not null").select("id", "parent", "child", "w1", "w2", "e1", "e2", low.alias("low"), F.xxhash64("id").alias("draw"))
    above = unary.select(F.col("id").alias("parent"), F.struct("low", "draw", "id").alias("above"))
    pairs = unary.join(above, "parent").select("id", "parent", (F.struct("low", "draw", "id") < F.col("above")).alias("lower"))
    lost = pairs.select(F.when(F.col("lower"), F.col("parent")).otherwise(F.col("id")).alias("id")).distinct()
    gone = unary.join(lost, "id", "left_anti")
    none = F.lit(None).cast("long")
    moves = gone.select("id", F.lit(True).alias("spliced"), F.lit(None).cast(tree.schema["id"].dataType).alias("to"), none.alias("m1"), none.alias("m2"))
    moves = moves.unionByName(
        gone.select(F.col("child").alias("id"), F.lit(False).alias("spliced"), F.col("parent").alias("to"), *[(F.col(f"w{i}") + F.col(f"e{i}")).alias(f"m{i}") for i in (1, 2)])
    )
    moved = tree.join(moves, "id", "left")
    return moved.select(
        "id", F.coalesce("to", "parent").alias("parent"), "depth", "w1", "w2",
        *[(F.col(f"e{i}") + F.coalesce(f"m{i}", F.lit(0))).alias(f"e{i}") for i in (1, 2)],
        *[F.when(F.col("to").isNotNull(), F.col(f"e{i}")).alias(f"c{i}") for i in (1, 2)],
        "kids", "child", F.coalesce("spliced", F.lit(False)).alias("spliced"),
    )


def _expanded(rounds: list[DataFrame]) -> DataFrame:
    """Totals of all nodes: a raked node's weight; a spliced one's by its child, last round first."""
    totals: list[DataFrame] = []
    for after in reversed(rounds):
        leaves = after.where("not spliced and kids = 0").select("id", F.col("w1").alias("t1"), F.col("w2").alias("t2"))
        totals.append(leaves)
        spliced = after.where("spliced").select("id", "child", "w1", "w2")
        if spliced.isEmpty():
            continue
        edges = after.where("c1 is not null").select(F.col("id").alias("child"), "c1", "c2")
        below = _union(totals).withColumnRenamed("id", "child")
        back = spliced.join(edges, "child").join(below, "child").select(
            "id", *[(F.col(f"w{i}") + F.col(f"c{i}") + F.col(f"t{i}")).alias(f"t{i}") for i in (1, 2)]
        )
        totals.append(stored(back, "expanded"))
    return _union(totals)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def end_digests(ends: DataFrame) -> DataFrame:
    """``node, conv_id`` to ``node, ends_sha256`` of the ids in ascending order, joined by commas.

    A digest is one stream by nature: the ids are joined in ranges first, and a node's ranges
    pass by one at a time.
    """
    ranges = ends.groupBy("node", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids")
    )
    schema = arrow_schema("a long, b long, ends_sha256 string")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (a, b) != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield as_batch(done, schema)
        if now is not None:
            yield as_batch([(*now, digest.hexdigest())], schema)

    ordered = ranges.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "range", "ids")
    ordered = ordered.repartition("a", "b").sortWithinPartitions("a", "b", "range").select("a", "b", "ids")
    done = ordered.mapInArrow(task, "a long, b long, ends_sha256 string")
    return done.select(F.struct("a", "b").alias("node"), "ends_sha256")


def trie(paths: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``conv_id, place, said, words, length`` rows.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens`` (words that need no second encoding in the subtree), ``ends_sha256``.
    """
    members = stored(keyed(paths), "paths")
    nodes = members.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("place").alias("depth"), F.max("parent").alias("parent"),
        F.count("*").alias("n_convs"), F.max("words").alias("words"),
    )
    nodes = stored(nodes, "nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    saved = (F.col("n_convs") - 1) * F.col("words")
    tree = nodes.select(F.col("node").alias("id"), "parent", "depth", (F.col("n_children") == 0).cast("long").alias("w1"), saved.alias("w2"))
    totals = subtree_totals(tree).select(F.col("id").alias("node"), F.col("t1").alias("n_leaves"), F.col("t2").alias("saved_tokens"))
    ends = end_digests(members.where("place = length").select("node", "conv_id"))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(totals, "node").join(ends, "node", "left").join(parents, "parent", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
