"""Latency, errors, health and cost, from a log with one row per call.

Every aggregate here has a small mergeable state, so rows are combined before
the shuffle and a variant with most of the rows does no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.functions import rules
from veilwork.operators.model import RetryPolicy, score_with_model
from veilwork.operators.variants import score_by_variant
from veilwork.session import run_dir

# ---- fixed value: the text a health check sends --------------------------
PROBE_TEXT = "Test health check"
# --------------------------------------------------------------------------
#: Groups whose figures are broadcast, of some 100 bytes each.
FEW_GROUPS = 100_000
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def latency_summary(df: DataFrame, by: str, latency: str = "latency") -> DataFrame:
    """Mean, sample deviation (0 for a single value) and number of values."""
    return df.groupBy(by).agg(
        F.avg(latency).alias("mean_latency"),
        F.coalesce(F.stddev_samp(latency), F.when(F.count(latency) > 0, 0.0)).alias("std_latency"),
        F.count(latency).alias("n_samples"),
    )


def latency_percentiles(
    df: DataFrame, by: str, latency: str = "latency", accuracy: int = 10_000
) -> DataFrame:
    """P50, P90 and P99, from one sketch per group.

    The sketch has a bounded size; a rank is off by at most ``1 / accuracy`` of
    the rows.  ``percentile_ranks`` tells by how much.
    """
    found = F.percentile_approx(latency, list(PERCENTILES.values()), accuracy).alias("p")
    out = df.groupBy(by).agg(found, F.count(latency).alias("n_samples"))
    return out.select(by, *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(PERCENTILES)], "n_samples")


def percentile_ranks(
    df: DataFrame, by: str, latency: str = "latency", accuracy: int = 10_000
) -> DataFrame:
    """The percentiles, and for each whether its true rank lies within the stated error.

    A second pass counts the values below and up to each percentile.  The
    figures of the groups, a row each, are written and then joined to the calls:
    broadcast if the rows, which are counted, are few, so that calls of a few
    groups are not dealt out by group.
    """
    path = run_dir(df.sparkSession, "percentiles")
    latency_percentiles(df, by, latency, accuracy).write.parquet(path)
    figures = df.sparkSession.read.parquet(path)
    if figures.count() <= FEW_GROUPS:
        figures = F.broadcast(figures)
    calls = df.select(F.col(by).alias("_by"), F.col(latency).alias("_value"))
    met = calls.join(figures, F.col("_by").eqNullSafe(F.col(by))).where(F.col("_value").isNotNull())
    counts = [
        c for name in PERCENTILES for c in (
            F.count_if(F.col("_value") < F.col(name)).alias(f"_below_{name}"),
            F.count_if(F.col("_value") <= F.col(name)).alias(f"_upto_{name}"),
        )
    ]
    counted = met.groupBy(by, "n_samples", *PERCENTILES).agg(*counts)
    fits = []
    for name, share in PERCENTILES.items():
        rank, off = F.ceil(F.lit(share) * F.col("n_samples")), F.ceil(F.col("n_samples") / accuracy)
        fits.append(((F.col(f"_below_{name}") < rank + off) & (F.col(f"_upto_{name}") >= rank - off)).alias(f"{name}_fits"))
    return counted.select(by, "n_samples", *PERCENTILES, *fits)


def error_rate(
    df: DataFrame, by: str, is_error: str = "is_error", code: str | None = None,
    throttling: tuple[str, ...] = rules.RETRY_CODES,
) -> DataFrame:
    """Calls, errors and their share; with a column of error codes, throttled calls as well."""
    throttled = [] if code is None else [
        F.count_if(F.col(code).isin(*throttling)).alias("n_throttled"),
        F.avg(F.coalesce(F.col(code).isin(*throttling).cast("double"), F.lit(0.0))).alias("throttling_rate"),
    ]
    return df.groupBy(by).agg(
        F.count("*").alias("n_calls"),
        F.count_if(F.col(is_error)).alias("n_errors"),
        F.avg(F.coalesce(F.col(is_error).cast("double"), F.lit(0.0))).alias("error_rate"),
        *throttled,
    )


def health_rollup(
    df: DataFrame, by: str, order: list[str], ok: str = "ok", latency: str = "latency",
    error: str = "error",
) -> DataFrame:
    """Health per variant, by its last call, and one overall row.

    Overall is healthy only if every variant is; else it is degraded.
    """
    last = F.max_by(F.struct(ok, latency, error), F.struct(*order))
    variants = (
        df.groupBy(F.col(by).alias("variant"))
        .agg(last.alias("l"))
        .select(
            "variant",
            F.coalesce(F.col(f"l.{ok}"), F.lit(False)).alias("ok"),
            F.col(f"l.{latency}").alias("latency"),
            F.col(f"l.{error}").alias("error"),
        )
    )
    # the overall row comes from the few variant rows, not from the log again
    rolled = variants.rollup("variant").agg(
        F.grouping("variant").alias("all"),
        F.bool_and("ok").alias("ok"),
        F.max("latency").alias("latency"),
        F.max("error").alias("error"),
    )
    one, fine = F.col("all") == 0, F.col("ok")
    return rolled.select(
        F.when(one, "variant").otherwise("overall").alias("scope"),
        "variant",
        F.when(fine | fine.isNull(), "healthy")
        .otherwise(F.when(one, "unhealthy").otherwise("degraded"))
        .alias("status"),
        F.when(one & fine, F.col("latency")).alias("response_time"),
        F.when(one & ~fine, F.col("error")).alias("error"),
    )


def health_check(
    spark: SparkSession, models: dict[str, Callable[[], Callable]], retry: RetryPolicy | None = None
) -> DataFrame:
    """Send one text to each model and roll the outcome up."""
    probes = spark.createDataFrame([(name, PROBE_TEXT) for name in models], "variant string, text string")
    calls = score_by_variant(
        probes,
        "variant",
        {
            name: (lambda d, make=make: score_with_model(d, "text", make, 1, retry))
            for name, make in models.items()
        },
    )
    log = calls.select(
        "variant", (F.col("status") == rules.STATUS_OK).alias("ok"),
        F.col("latency_seconds").alias("latency"), "error",
    )
    return health_rollup(log, "variant", ["variant"])


def batch_throughput(df: DataFrame, batch: str = "batch_no", latency: str = "latency") -> DataFrame:
    """Cost per batch: the total, and the share of one text."""
    total = F.sum(latency)
    return df.groupBy(batch).agg(
        F.count("*").alias("n_texts"),
        total.alias("total_seconds"),
        (total / F.count("*")).alias("seconds_per_text"),
    )
