"""Latency figures that merge: stored sketches per span of time and variant, joined to any longer span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilwork.operators.metrics import PERCENTILES
from veilwork.operators.rows import quoted

#: Values a sketch keeps exactly; above, its size stays and ranks are off by ``rank_error``.
SKETCH = 8192


def rank_error(k: int = SKETCH) -> float:
    """Share of the rows by which a rank is off at most, at 99 % confidence (KLL, one-sided)."""
    return 2.296 / k ** 0.9021


def sketch_columns(latency: Column, is_error: Column, k: int = SKETCH) -> list[Column]:
    """Aggregates whose results add up or merge."""
    return [
        F.count("*").alias("n_calls"), F.count_if(is_error).alias("n_errors"),
        F.count(latency).alias("n_samples"), F.sum(latency).alias("sum_latency"),
        F.call_function("kll_sketch_agg_double", latency.cast("double"), F.lit(k)).alias("sketch"),
    ]


def merged_columns(k: int = SKETCH) -> list[Column]:
    """The same columns again, from rows of them."""
    return [
        *[F.sum(c).alias(c) for c in ("n_calls", "n_errors", "n_samples", "sum_latency")],
        F.call_function("kll_merge_agg_double", F.col("sketch"), F.lit(k)).alias("sketch"),
    ]


def latency_sketches(
    calls: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("variant",), latency: str = "latency",
    is_error: str = "is_error", span: str = "hour", k: int = SKETCH,
) -> DataFrame:
    """One row per span (as ``span_start``) and group: counts, the sum of latencies and their sketch.

    Store it (by appending spans as they end) and merge as needed.  Tasks add up
    their own rows first, so what is shuffled is a sketch a task and group.
    """
    start = F.date_trunc(span, F.col(ts)).alias("span_start")
    return calls.groupBy(start, *quoted(by)).agg(*sketch_columns(F.col(latency), F.col(is_error), k))


def merge_sketches(sketches: DataFrame, by: list[Column | str], k: int = SKETCH) -> DataFrame:
    """Figures of any groups of stored rows: counts, error rate, mean, percentiles and ``rank_error``.

    A percentile is a value of the data whose rank is off by at most that share
    of the rows; it is 0, and the percentile exact, while a group has no more
    values than the sketch keeps.  Groups without a value have NULL percentiles.
    """
    sums = merged_columns(k)
    merged = sketches.groupBy(*by).agg(*sums)
    return merged.select(*quoted(merged.columns[:-len(sums)]), *figures(k))


def figures(k: int = SKETCH) -> list[Column]:
    """What merged columns say."""
    ranks = F.array(*[F.lit(q) for q in PERCENTILES.values()])
    found = F.when(F.col("n_samples") > 0, F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), ranks))
    return [
        F.col("n_calls"), F.col("n_errors"), F.col("n_samples"),
        F.expr("n_errors / nullif(n_calls, 0)").alias("error_rate"),
        F.expr("sum_latency / nullif(n_samples, 0)").alias("mean_latency"),
        *[F.get(found, F.lit(i)).alias(name) for i, name in enumerate(PERCENTILES)],
        F.when(F.col("n_samples") <= k, F.lit(0.0)).otherwise(F.lit(rank_error(k))).alias("rank_error"),
    ]
