"""Event-time windows in which every call is accounted for: closed, open or late.

The engine's own windows give a window once, when the watermark has passed it;
open windows stay unseen, and late rows are dropped without a trace.  Here each
micro-batch is added to the open windows of the one before, and writes three
tables: windows that closed with it, the windows still open (provisional), and
the rows that came too late for their window.  All of a batch's writes are named
by its number and overwrite what a lost attempt has left, so each call is
counted once, also after a restart from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from veilwork.operators import sketches
from veilwork.operators.rows import quoted

#: Batches whose open windows are kept: a batch reads those of the one before it.
_SLOTS = 3


def write_accounts(
    calls: DataFrame,
    path: str,
    checkpoint: str,
    window: str = "1 minute",
    delay: str = "5 minutes",
    ts: str = "ts",
    latency: str = "latency",
    is_error: str = "is_error",
    by: tuple[str, ...] = (),
    k: int = sketches.SKETCH,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep ``closed``, ``open`` and ``late`` below ``path`` up to date.

    The watermark is the latest event time of the batches before, less
    ``delay``; a row whose window it has passed is late, and so is one without
    a time.  State is a sketch and a few sums per open window and group.
    """
    groups = ["window_start", "window_end", *quoted(by)]

    def account(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            before = _mark(spark, path, number - 1)
            passed = _ago(before, delay)
            # rows as they came in one struct; the window function drops rows without a time
            row = F.struct(*quoted(batch.columns)).alias("row")
            placed = batch.select(row, F.window(ts, window).alias("w"))
            is_late = F.coalesce(F.col("w.end") <= passed, F.lit(False))
            late = placed.where(is_late).select("row").unionByName(batch.where(F.col(ts).isNull()).select(row))
            _write(late.select("row.*"), f"{path}/late/batch={number}")
            on_time = placed.where(~is_late).groupBy(
                F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                *[F.col(f"row.{c}") for c in quoted(by)],
            ).agg(*sketches.sketch_columns(F.col(f"row.{latency}"), F.col(f"row.{is_error}"), k))
            if number > 0:
                on_time = spark.read.parquet(f"{path}/state/slot={(number - 1) % _SLOTS}").unionByName(on_time)
            merged = on_time.groupBy(*groups).agg(*sketches.merged_columns(k)).persist()
            latest = batch.agg(F.unix_micros(F.max(F.col(ts).cast("timestamp"))).alias("m"))
            latest = latest.select(F.greatest("m", F.lit(before).cast("long")).alias("latest"))
            _write(latest, f"{path}/marks/slot={number % _SLOTS}")
            closes = F.coalesce(F.col("window_end") <= _ago(_mark(spark, path, number), delay), F.lit(False))
            _write(merged.where(closes), f"{path}/closed/batch={number}")
            _write(merged.where(~closes), f"{path}/state/slot={number % _SLOTS}")
            merged.unpersist()
            # the last write: it names the slot that holds
            _write(spark.createDataFrame([(number,)], "batch bigint"), f"{path}/last")
        finally:
            batch.unpersist()

    writer = calls.writeStream.foreachBatch(account).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def _ago(micros: int | None, delay: str) -> Column:
    return F.timestamp_micros(F.lit(micros).cast("long")) - F.expr(f"INTERVAL {delay}")


def _mark(spark: SparkSession, path: str, number: int) -> int | None:
    """The latest event time up to a batch, in microseconds."""
    return spark.read.parquet(f"{path}/marks/slot={number % _SLOTS}").first()["latest"] if number >= 0 else None


def read_accounts(spark: SparkSession, path: str, k: int = sketches.SKETCH) -> DataFrame:
    """Figures of all windows: closed ones, and open ones as they stand (``provisional``)."""
    last = spark.read.parquet(f"{path}/last").first()["batch"]
    shut = spark.read.parquet(f"{path}/closed").where(F.col("batch") <= last).drop("batch")
    still = spark.read.parquet(f"{path}/state/slot={last % _SLOTS}")
    rows = shut.withColumn("provisional", F.lit(False)).unionByName(still.withColumn("provisional", F.lit(True)))
    sums = ("n_calls", "n_errors", "n_samples", "sum_latency", "sketch")
    return rows.select(*quoted(rows.columns, but=sums), *sketches.figures(k))


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late, as they came, with the batch that met them."""
    last = spark.read.parquet(f"{path}/last").first()["batch"]
    return spark.read.parquet(f"{path}/late").where(F.col("batch") <= last)
