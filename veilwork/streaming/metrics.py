"""Live latency and error figures in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from veilwork.operators.metrics import PERCENTILES


def metrics_stream(
    calls: DataFrame,
    window: str = "1 minute",
    watermark: str = "5 minutes",
    ts: str = "ts",
    latency: str = "latency",
    is_error: str = "is_error",
    by: str | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """Figures per window, and per variant if ``by`` is given.

    State is one small sketch per open window; the watermark closes windows
    and drops their state.
    """
    keys = [F.window(ts, window).alias("w")] + ([F.col(by)] if by else [])
    figures = (
        calls.withWatermark(ts, watermark)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_calls"),
            F.count_if(F.col(is_error)).alias("n_errors"),
            F.avg(latency).alias("mean_latency"),
            F.percentile_approx(latency, list(PERCENTILES.values()), accuracy).alias("p"),
        )
    )
    return figures.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *([by] if by else []),
        "n_calls", "n_errors",
        (F.col("n_errors") / F.col("n_calls")).alias("error_rate"),
        "mean_latency", *[F.get("p", F.lit(i)).alias(name) for i, name in enumerate(PERCENTILES)],
    )


def write_metrics(
    figures: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append each window once, when the watermark has passed it."""
    writer = (
        figures.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
