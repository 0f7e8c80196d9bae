"""Splitting rows between scorer variants."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from veilwork.functions import rules
from veilwork.functions.text import hash_bucket


def assign_variant(df: DataFrame, key: str, weights: dict[str, float], out: str = "variant") -> DataFrame:
    """Give each row a variant in proportion to the weights.

    The split hangs on the key alone: stable between runs, and raising one
    weight moves as few keys as the change needs.
    """
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    bucket = F.expr(hash_bucket(key, "variant"))
    chosen, upto = None, 0.0
    for name, weight in weights.items():
        upto += weight
        limit = round(10000 * upto / total)
        test = bucket < limit
        chosen = F.when(test, name) if chosen is None else chosen.when(test, name)
    return df.withColumn(out, chosen)


def score_by_variant(
    df: DataFrame,
    variant_col: str,
    scorers: dict[str, str | Callable[[DataFrame], DataFrame]],
    out: str = "scored",
) -> DataFrame:
    """Send each row to the scorer its variant column names.

    SQL-expression scorers of one type run in a single pass, as one CASE whose
    value goes to ``out``.  Scorers that are functions on tables (models) each
    get the rows of their variant, and have to add the same columns.  Rows
    that name no known scorer stay, as failed rows.
    """
    known = F.coalesce(F.col(variant_col).isin(list(scorers)), F.lit(False))
    error = F.concat(
        F.lit("no scorer for variant "), F.coalesce(F.col(variant_col), F.lit("NULL"))
    )
    status = {
        "error": F.when(~known, error),
        "status": F.when(known, rules.STATUS_OK).otherwise(rules.STATUS_FAILED),
    }
    if all(isinstance(s, str) for s in scorers.values()):
        value = F.lit(None)
        for name, sql in scorers.items():
            value = F.when(F.col(variant_col) == name, F.expr(sql)).otherwise(value)
        return df.withColumn(out, value).withColumns(status)
    def scored(name: str, scorer) -> DataFrame:
        table = scorer(df.where(F.col(variant_col) == name))
        # a scorer that can fail brings error and status of its own
        return table if "status" in table.columns else table.withColumns(status)

    tables = [scored(name, scorer) for name, scorer in scorers.items()]
    tables.append(df.where(~known).withColumns(status))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
