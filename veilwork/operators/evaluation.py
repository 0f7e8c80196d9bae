"""Evaluation runs: judge results against expectations, sum up, list failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EVAL_FIELDS = (
    "suite", "test", "success", "latency", "entities_found", "confidence", "expected", "actual", "error",
)


def evaluate_injection(judged: DataFrame, expected: str = "expected") -> DataFrame:
    """Add ``success``: the decision is what was expected."""
    wanted = F.when(F.col(expected) == "INJECTION", True).when(F.col(expected) == "SAFE", False)
    return judged.withColumn(
        "success", F.coalesce(wanted == F.col("is_injection"), F.lit(False))
    )


def confusion_counts(evaluated: DataFrame, expected: str = "expected") -> DataFrame:
    return evaluated.groupBy(
        F.col(expected).alias("expected"), F.col("classification").alias("actual")
    ).agg(F.count("*").alias("n"), F.count_if("success").alias("n_passed"))


def evaluate_pii(masked: DataFrame, expected: str = "expected_types") -> DataFrame:
    """Add ``success``: something was found; and whether an expected type was."""
    return masked.withColumns(
        {
            "entities_found": F.size("entities"),
            "success": F.size("entities") > 0,
            "type_found": F.arrays_overlap(F.col("entities.type"), F.col(expected)),
        }
    )


def suite_summary(log: DataFrame) -> DataFrame:
    """Passed and total per suite and overall, with means over rows that have values.

    The log is summed up per suite first; the overall row is rolled up from
    those few rows.
    """
    sums = log.groupBy("suite").agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("passed"),
        F.sum("latency").alias("_ls"),
        F.count("latency").alias("_ln"),
        F.sum("confidence").alias("_cs"),
        F.count("confidence").alias("_cn"),
    )
    rolled = sums.rollup("suite").agg(
        *[F.sum(c).alias(c) for c in ("total", "passed", "_ls", "_ln", "_cs", "_cn")],
        F.grouping("suite").alias("_all"),
    )
    return rolled.select(
        F.when(F.col("_all") == 1, "overall").otherwise(F.col("suite")).alias("suite"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("passed", F.lit(0)).alias("passed"),
        F.coalesce(F.col("total") - F.col("passed"), F.lit(0)).alias("failed"),
        F.expr("round(100.0D * passed / nullif(total, 0), 1)").alias("success_rate"),
        F.expr("_ls / nullif(_ln, 0)").alias("mean_latency"),
        F.expr("_cs / nullif(_cn, 0)").alias("mean_confidence"),
    )


def failure_report(log: DataFrame) -> DataFrame:
    """Failed tests with the reason: the error, or what came out instead.

    The log passes through a one-row generator, so that a dear column of it is
    not worked out again in the filter.
    """
    log = log.select(F.explode(F.array(F.struct("suite", "test", "success", "expected", "actual", "error"))).alias("r"))
    log = log.select("r.*")
    missed = F.concat(
        F.lit("Expected "),
        F.coalesce("expected", F.lit("N/A")),
        F.lit(" but got "),
        F.coalesce("actual", F.lit("N/A")),
    )
    nothing_known = F.col("expected").isNull() & F.col("actual").isNull()
    reason = F.when(F.col("error") != "", F.col("error")).when(
        nothing_known, F.lit("Unknown error")
    )
    return log.where(~F.coalesce("success", F.lit(False))).select(
        "suite", "test", reason.otherwise(missed).alias("reason")
    )
