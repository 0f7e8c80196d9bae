"""Found spans beside expected ones: matches, precision, recall and F1 by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.operators.rows import quoted


def match_spans(
    df: DataFrame, key: str, expected_col: str, found_col: str, least: float = 0.5,
) -> DataFrame:
    """One row per span of either list: key, side, label, start, end, matched and exact.

    The columns hold lists of structs with label (or ``entity_group``), start
    and end.  Two spans of one label match if more than ``least`` of their union
    is shared, which is at least one half; where the spans of a list that have
    one label do not overlap, as after ``resolve_spans``, a span then has one
    partner at most.  Of two partners the one that begins later has in the other
    the last span of that list to begin before it, so one sorted sweep over the
    spans of a text and label finds all; no span is held against all others.
    Repeated spans of a list are one.  Spans without an end behind their start
    count, and match nothing.  The key tells texts apart.
    """
    if not 0.5 <= least < 1:
        raise ValueError("least must be at least 0.5 and below 1, or a span could match several")
    sides = [_listed(df, key, expected_col, "expected"), _listed(df, key, found_col, "found")]
    rows = sides[0].unionByName(sides[1]).distinct()
    before = Window.partitionBy("key", "label").orderBy("start", "end", "side").rowsBetween(Window.unboundedPreceding, -1)
    span = F.struct("side", "start", "end")
    last = {
        side: F.last(F.when((F.col("side") == side) & (F.col("end") > F.col("start")), span), ignorenulls=True).over(before)
        for side in ("expected", "found")
    }
    swept = rows.select("*", last["expected"].alias("e"), last["found"].alias("f"))
    swept = swept.withColumn("p", F.when(F.col("side") == "found", F.col("e")).otherwise(F.col("f")))
    alike = F.coalesce(_alike(F.col("p"), least), F.lit(False))
    exact = alike & (F.col("p.start") == F.col("start")) & (F.col("p.end") == F.col("end"))
    told = F.array(F.struct(span.alias("s"), alike.alias("m"), exact.alias("x")),
                   F.struct(F.when(alike, F.col("p")).alias("s"), alike.alias("m"), exact.alias("x")))
    told = swept.select("key", "label", F.explode(told).alias("t")).where("t.s IS NOT NULL")
    # dealt by key and label already
    judged = told.groupBy("key", "label", "t.s").agg(F.max("t.m").alias("matched"), F.max("t.x").alias("exact"))
    return judged.select(F.col("key").alias(key), "s.side", "label", "s.start", "s.end", "matched", "exact")


def _listed(df: DataFrame, key: str, col: str, side: str) -> DataFrame:
    kind = df.schema[col].dataType.elementType.names
    label = "e.label" if "label" in kind else "coalesce(e.entity_group, e.entity)"
    (name,) = quoted([key])
    return df.selectExpr(f"{name} AS key", f"explode({quoted([col])[0]}) AS e").selectExpr(
        "key", f"'{side}' AS side", f"{label} AS label", "CAST(e.start AS bigint) AS start", "CAST(e.end AS bigint) AS `end`"
    )


def _alike(p: Column, least: float) -> Column:
    shared = F.least("end", p["end"]) - F.greatest("start", p["start"])
    whole = F.greatest("end", p["end"]) - F.least("start", p["start"])
    # least and greatest pass over NULLs
    return p.isNotNull() & (shared > 0) & (shared > least * whole)


def span_scores(matches: DataFrame) -> DataFrame:
    """Counts, precision, recall and F1 by label, and over all as label ``overall``.

    Tasks add up their own spans first.  Shares of nothing are NULL; F1 is 0
    where nothing is matched.
    """
    sums = matches.groupBy("label").agg(
        F.count_if(F.col("side") == "expected").alias("n_expected"),
        F.count_if(F.col("side") == "found").alias("n_found"),
        F.count_if((F.col("side") == "found") & F.col("matched")).alias("n_matched"),
        F.count_if((F.col("side") == "found") & F.col("exact")).alias("n_exact"),
    )
    counts = ["n_expected", "n_found", "n_matched", "n_exact"]
    rolled = sums.rollup("label").agg(*[F.sum(c).alias(c) for c in counts], F.grouping("label").alias("_all"))
    return rolled.where("_all = 0 OR n_expected IS NOT NULL").select(
        F.expr("IF(_all = 1, 'overall', label)").alias("label"), *counts,
        F.expr("n_matched / nullif(n_found, 0)").alias("precision"),
        F.expr("n_matched / nullif(n_expected, 0)").alias("recall"),
        F.expr("2.0D * n_matched / nullif(n_found + n_expected, 0)").alias("f1"),
    )
