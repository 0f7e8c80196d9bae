"""Mixing sources to target weights by hierarchical budgets.

Weights are whole numbers on the nodes of a tree (domain, language, source).
A node's budget is dealt to its children by weight.  A child that cannot take
its share (all it has, ``max_epochs`` times over) takes what it can; the rest
goes to its siblings by weight, and leaves the subtree only if no sibling can
take more: each node is given no more than its subtree can take.  Each leaf
then takes its documents in whole epochs and, in the last one, the prefix of a
seeded order that fills the budget.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.llm.common import cut, join_small, packed, unpacked, words

#: Documents of a leaf per piece of the seeded order; only the piece in which the
#: budget ends is sorted.
PIECE = 4096


def order_number(seed: int, epoch: Column, key: Column) -> Column:
    """A number below 2**60 that places a document in a leaf's epoch."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), key)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _wide(c) -> Column:
    return F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")


def _weight(c: str) -> Column:
    return F.col(c).cast("decimal(12,0)")


def node_weights(spark, levels: list[str], weights: Mapping[tuple, int]) -> DataFrame:
    """(path, w) of the nodes that have a weight; all others count 1."""
    rows = [("\x01".join(path), int(w)) for path, w in weights.items()] or [("\x00", 1)]
    if min(w for _, w in rows) < 0 or max(map(len, weights), default=0) > len(levels):
        raise ValueError("weights are whole numbers from 0 on nodes of the tree")
    return spark.createDataFrame(rows, "path string, w long")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Mapping[tuple, int],
                 budget: int, max_epochs: int) -> DataFrame:
    """Deal ``budget`` tokens to the leaves (levels, supply); adds ``budget``.

    Within a node children are ordered by capacity per weight; one is full if
    its share of what those before it left exceeds its capacity, and all behind
    the last full one share the rest.  Whole numbers throughout, so the sum is
    exact.  One row per node goes through these windows, never documents.
    """
    given = node_weights(leaves.sparkSession, levels, weights)
    path = lambda n: F.concat_ws("\x01", *levels[:n]) if n else F.lit("")
    nodes: dict[int, DataFrame] = {}
    below = leaves.withColumn("cap", F.col("supply") * max_epochs)
    for depth in range(len(levels), 0, -1):
        summed = below.groupBy(*levels[:depth]).agg(F.sum("cap").cast("long").alias("cap"))
        node = summed.withColumn("path", path(depth)).join(F.broadcast(given), "path", "left")
        node = node.withColumn("w", F.coalesce("w", F.lit(1).cast("long")))
        node = node.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)))
        nodes[depth] = below = cut(node, "mix-nodes")
    total = nodes[1].agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap")).select(
        F.lit("").alias("parent"), F.least(F.col("cap"), F.lit(budget)).cast("long").alias("b")
    )
    for depth in range(1, len(levels) + 1):
        node = nodes[depth].withColumn("parent", path(depth - 1)).join(total, "parent")
        sort = ["live", "whole", "part", "path"]
        node = (
            node.withColumn("live", (F.col("w") == 0).cast("int"))
            .withColumn("whole", F.expr("CASE WHEN w > 0 THEN cap div w ELSE 0 END"))
            .withColumn("part", F.expr("CASE WHEN w > 0 THEN (cap % w) / w ELSE 0D END"))
        )
        rows = Window.partitionBy("parent").orderBy(*sort)
        before = rows.rowsBetween(Window.unboundedPreceding, -1)
        behind = rows.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        node = node.withColumn("left", F.col("b") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        node = node.withColumn("rest", F.sum("w").over(behind))
        node = node.withColumn(
            "full",
            (F.col("w") == 0)
            | (_wide("cap") * _weight("rest") <= _wide("left") * _weight("w")),
        )
        whole = Window.partitionBy("parent")
        open_w = F.when(~F.col("full"), F.col("w")).otherwise(0)
        node = (
            node.withColumn("room", F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
            .withColumn("open", F.sum(open_w).over(whole))
            .withColumn("upto", F.sum(open_w).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
        )
        share = lambda upto: f"(CAST(room AS decimal(19,0)) * CAST({upto} AS decimal(12,0))) div CAST(open AS decimal(12,0))"
        node = node.withColumn(
            "b", F.expr(f"CASE WHEN full THEN cap ELSE {share('upto')} - {share('upto - w')} END")
        )
        # below a full parent the same holds with no room left over
        total = cut(node.select(F.col("path").alias("parent"), F.col("b").cast("long").alias("b"), *levels[:depth]), "mix-budget")
        if depth < len(levels):
            total = total.select("parent", "b")
    return leaves.join(total.drop("parent").withColumnRenamed("b", "budget"), levels)


def choose(docs: DataFrame, levels: list[str], weights: Mapping[tuple, int], budget: int | None = None,
           budget_share: float = 1.0, max_epochs: int = 4, seed: int = 1,
           key: str = "doc_id", tokens: str = "n_tokens") -> tuple[DataFrame, DataFrame]:
    """Leaf table with what each leaf takes, and the documents with their order number inputs."""
    spark = docs.sparkSession
    light = docs.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in levels],
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_key"),
        F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("long").alias("_n"),
    )
    light = cut(light, "mix-light")
    leaves = cut(
        light.groupBy(*levels).agg(F.sum("_n").alias("supply"), F.count("*").alias("n_docs")), "mix-leaves"
    )
    if budget is None:
        supply = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("s")).first()["s"]
        budget = int(supply * budget_share)
    leaves = leaf_budgets(leaves, levels, weights, budget, max_epochs)
    leaves = leaves.select(
        *levels, "supply", "n_docs", "budget",
        F.expr("CASE WHEN supply > 0 THEN budget div supply ELSE 0 END").alias("epochs"),
        F.expr("CASE WHEN supply > 0 THEN budget % supply ELSE 0 END").alias("rest"),
    )
    leaves = cut(leaves, "mix-leaves")
    placed = join_small(light, leaves.where("rest > 0"), levels, "inner")
    placed = placed.withColumn("_u", order_number(seed, F.col("epochs"), F.col("_key")))
    pieces = F.greatest(F.lit(1).cast("long"), F.expr(f"n_docs div {PIECE}"))
    placed = placed.withColumn("_pieces", pieces)
    placed = placed.withColumn("_piece", F.expr("shiftright(shiftright(_u, 30) * _pieces, 30)"))
    sums = placed.groupBy(*levels, "rest", "_piece").agg(F.sum("_n").alias("_s"))
    run = Window.partitionBy(*levels).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(run), F.lit(0)))
    last = cut(
        sums.where("_before < rest AND _before + _s >= rest").select(*levels, "_piece", "_before"), "mix-last"
    )
    ends = join_small(placed, last, [*levels, "_piece"], "inner")
    ends = ends.groupBy(*levels, "rest", "_before", "_u", "_key").agg(F.sum("_n").alias("_s"))
    run = Window.partitionBy(*levels).orderBy("_u", "_key").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_s").over(run), F.lit(0)))
    ends = ends.where("_at < rest AND _at + _s >= rest").select(
        *levels, F.col("_u").alias("cut_u"), F.col("_key").alias("cut_key")
    )
    return cut(leaves.join(ends, levels, "left"), "mix-chosen"), light


def mix_to_weights(docs: DataFrame, levels: list[str], weights: Mapping[tuple, int],
                   budget: int | None = None, budget_share: float = 1.0, max_epochs: int = 4,
                   seed: int = 1, key: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """The documents, with ``copies``: how many times each is taken (0: not at all).

    ``levels`` are the tree's columns from the root; null there counts as the
    empty name.  ``weights`` maps paths (``("web",)``, ``("web", "en")``) to
    whole numbers; others count 1, and 0 takes nothing.  ``budget`` is in tokens;
    without one it is ``budget_share`` of all tokens.  The document in which a
    leaf's budget ends is taken whole, so a leaf goes over by less than one
    document; rows that share a ``key`` stand at one place and are taken
    together.  Null tokens count 0.  An empty table gives an empty one.  A
    column named ``copies`` gives way; all other columns stay.

    Three passes over light rows (levels, key, tokens) and one over the table;
    the tables joined with it have one row per leaf.
    """
    chosen, _ = choose(docs, levels, weights, budget, budget_share, max_epochs, seed, key, tokens)
    names = [c for c in docs.columns if c != "copies"]
    at = [f"leaf_{i}" for i in range(len(levels))]
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    side = chosen.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(levels, at)], "epochs", "cut_u", "cut_key")
    rows = packed(docs, own=name(key), **{x: name(c) for c, x in zip(levels, at)})
    out = join_small(rows, side, at, "left")
    u = order_number(seed, F.col("epochs"), F.col("own"))
    taken = (u < F.col("cut_u")) | ((u == F.col("cut_u")) & (F.col("own") <= F.col("cut_key")))
    copies = F.coalesce("epochs", F.lit(0)) + F.coalesce(taken, F.lit(False)).cast("long")
    return out.select(*unpacked(names), copies.alias("copies"))


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
