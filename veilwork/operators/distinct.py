"""Score each distinct text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from veilwork.operators.rows import fresh, quoted
from veilwork.operators.skew import salted_join


def score_distinct(
    df: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    key: str,
    text_col: str = "text",
    rows_per_part: int = 1_000_000,
) -> DataFrame:
    """Run ``scorer`` over the distinct texts and give the answer to all copies.

    Worth its shuffles where scoring is dear: a model, not the rules.  Texts
    are told apart by a 256-bit digest; copies are combined before the first
    shuffle, and the answers come back to the rows by the digest, those of a
    text with many copies spread over parts of about ``rows_per_part`` rows.
    """
    digest = fresh("_digest", df)
    told = df.withColumn(digest, F.sha2(F.col(text_col), 256))
    one = told.where(F.col(text_col).isNotNull()).groupBy(digest).agg(F.first(text_col).alias(text_col))
    scored = scorer(one.select(text_col))
    answers = scored.withColumn(digest, F.sha2(F.col(text_col), 256)).drop(text_col)
    # columns that the scorer adds take the place of the table's
    told = told.select(*quoted(told.columns, but=set(scored.columns) - {text_col}))
    return salted_join(told, answers, digest, spread_by=key, rows_per_part=rows_per_part).drop(digest)
