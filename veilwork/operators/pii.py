"""Operators that find and mask personal data.

All are narrow: one row in, one row (or its entities) out, no shuffle, except
the totals over a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilwork import functions as vf
from veilwork.functions import rules, spans
from veilwork.operators.rows import add_once, fresh, quoted, unroll


def add_entities(
    df: DataFrame, text_col: str = "text", out: str = "raw_entities", pii_rules=rules.PII_RULES
) -> DataFrame:
    return add_once(df, out, spans.detect_entities(text_col, pii_rules))


def mask_pii(
    df: DataFrame,
    text_col: str = "text",
    return_entities: bool = True,
    pii_rules=rules.PII_RULES,
    entities_col: str | None = None,
) -> DataFrame:
    """Add ``masked_text`` and, if wanted, the listed ``entities``.

    The mask covers all spans; the list holds those above the score.  Spans
    come from the rules, or from ``entities_col`` where a model gave them.
    """
    added = ["masked_text", "entities"] if return_entities else ["masked_text"]
    keep = quoted(df.columns, but=added)
    if entities_col is None:
        entities_col = fresh("_found", df)
        df = add_entities(df, text_col, entities_col, pii_rules)
    columns = {
        "masked_text": vf.apply_mask(text_col, entities_col),
        "entities": vf.extract_entities(entities_col),
    }
    return df.select(*keep, *[columns[c].alias(c) for c in added])


def entity_rows(masked: DataFrame, *keys: str) -> DataFrame:
    """One row per listed entity."""
    return unroll(masked, "entities", "entity_no", *keys).select(*keys, "entity_no", "e.*")


def pii_type_counts(masked: DataFrame, *keys: str) -> DataFrame:
    """Number of entities by type, per row.  Counted inside the row."""
    counted = f"map_entries({spans.type_counts('entities')})"
    return unroll(masked, counted, "_no", *keys).select(
        *keys, F.col("e.key").alias("type"), F.col("e.value").alias("n")
    )


def pii_type_totals(masked: DataFrame) -> DataFrame:
    """Number of entities by type, over the whole table."""
    rows = unroll(masked, "entities.type", "_no").select(F.col("e").alias("type"))
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def pii_status(masked: DataFrame, text_col: str = "text") -> DataFrame:
    """Masked if the text changed, clean if not; and the types found."""
    return masked.withColumn(
        "pii_status",
        F.when(F.col("masked_text") != F.col(text_col), "masked").otherwise("clean"),
    ).withColumn("types", F.array_sort(F.array_distinct("entities.type")))


def deidentify_records(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Masked records with the number of elements taken out."""
    masked = mask_pii(df, text_col)
    return masked.withColumn("pii_count", F.size("entities")).drop(text_col, "entities")


def redaction_summary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Per document: short forms of both texts for a log, and counts by type."""
    masked = mask_pii(df, text_col)
    keep = quoted(df.columns, but=[text_col])
    return masked.select(
        *keep,
        vf.preview(text_col, 100).alias("original_preview"),
        vf.preview("masked_text", 150).alias("masked_preview"),
        F.expr(spans.type_counts("entities")).alias("type_counts"),
    )
