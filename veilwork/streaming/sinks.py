"""One stream into several tables, each row once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from veilwork.functions import rules
from veilwork.operators.injection import route


def write_tables(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    tables: Mapping[str, tuple[Column, list[str | Column]]],
    available_now: bool = False,
) -> StreamingQuery:
    """Write each micro-batch to several tables below ``path``; ``tables`` has a filter and columns for each.

    A batch is worked out once and held while the tables are written.  What it
    writes to a table is a partition named by its number and replaces what a
    lost attempt has left there; a batch counts as a whole when all tables have
    it, which ``read_table`` waits for.  So a row is in each table once, however
    often its batch was tried, and tables never disagree on what has come in.
    """

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for name, (wanted, columns) in tables.items():
                held.where(wanted).select(*columns).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            done = batch.sparkSession.range(1).select(F.lit(number).alias("done"))
            done.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")
        finally:
            held.unpersist()

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one table from the batches that all tables have."""
    done = spark.read.parquet(f"{path}/batches").agg(F.max("done")).first()[0]
    return spark.read.parquet(f"{path}/{name}").where(F.col("batch") <= done).drop("batch")


def route_tables(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    text_col: str = "text",
    threshold: float = rules.INJECTION_THRESHOLD,
    available_now: bool = False,
) -> StreamingQuery:
    """Blocked messages for review, masked texts, and clean texts: a table each."""
    routed = route(messages, text_col, threshold)
    keys = [c for c in messages.columns if c != text_col]
    of = lambda name: F.col("decision") == name
    return write_tables(routed, path, checkpoint, {
        "blocked": (of("blocked"), [*keys, text_col, "injection_score"]),
        "masked": (of("masked"), [*keys, "masked_text"]),
        "clean": (of("clean"), [*keys, text_col]),
    }, available_now)
