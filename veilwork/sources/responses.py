"""Requests for, and responses of, models that are called elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilwork import schemas
from veilwork.functions import rules

MALFORMED = "malformed response"


def parse_entities(df: DataFrame, json_col: str, out: str = "entities") -> DataFrame:
    """Token-classification responses; what cannot be read becomes NULL."""
    return df.withColumn(out, F.from_json(json_col, schemas.ENTITIES))


def parse_labels(df: DataFrame, json_col: str, out: str = "labels") -> DataFrame:
    """Label responses, as a flat list or as a list of lists."""
    return df.withColumn(
        out,
        F.coalesce(
            F.from_json(json_col, schemas.LABELS),
            F.flatten(F.from_json(json_col, f"array<{schemas.LABELS}>")),
        ),
    )


def with_status(df: DataFrame, parsed_col: str, error: str = MALFORMED) -> DataFrame:
    """Mark rows without a readable result as failed, and keep them.

    An error or a failed status that is there already stands.
    """
    failed = F.col(parsed_col).isNull()
    known = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("error", F.coalesce(known, F.when(failed, F.lit(error))))
    return df.withColumn(
        "status",
        F.when(F.col("error").isNotNull(), rules.STATUS_FAILED).otherwise(rules.STATUS_OK),
    )


def build_requests(batched: DataFrame, text_col: str = "text") -> DataFrame:
    """One JSON payload per batch, texts in order.

    ``batched`` comes from ``assign_batches``; a group is one batch, so its
    size is the batch size.
    """
    inputs = F.transform(
        F.array_sort(F.collect_list(F.struct("position", F.col(text_col).alias("t")))),
        lambda e: e["t"],
    )
    return batched.groupBy("batch_no").agg(
        F.count("*").alias("n_texts"),
        F.to_json(F.struct(inputs.alias("inputs"))).alias("payload"),
    )
