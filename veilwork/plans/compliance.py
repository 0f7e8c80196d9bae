"""The compliance report: both detectors over a table, and one row of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilwork import functions as vf
from veilwork.functions import injection as inj, rules
from veilwork.operators.pii import mask_pii, pii_type_totals

# ---- fixed values: the two status lines ---------------------------------
NO_PII = "No unmasked PII detected"
SOME_PII = "items require PII handling"
NO_INJECTION = "No injection attempts detected"
SOME_INJECTION = "injection attempts blocked"
# -------------------------------------------------------------------------


def compliance_flags(
    df: DataFrame,
    text_col: str = "text",
    seconds_col: str | None = None,
    threshold: float = rules.INJECTION_THRESHOLD,
) -> DataFrame:
    """What the report needs of each text; the text itself goes no further.

    Both detectors look at every text: the report does not hide the personal
    data of a text because the text is an attack.
    """
    seconds = F.col(seconds_col).cast("double") if seconds_col else F.lit(None).cast("double")
    return df.select(
        vf.detect_entities(text_col).alias("_found"),
        F.expr(inj.check_prompt_injection(text_col, threshold)).alias("is_injection"),
        seconds.alias("seconds"),
    ).select(
        vf.extract_entities("_found")["type"].alias("types"), "is_injection", "seconds"
    )


def compliance_report(
    df: DataFrame,
    text_col: str = "text",
    seconds_col: str | None = None,
    threshold: float = rules.INJECTION_THRESHOLD,
) -> DataFrame:
    """Counts, shares, times and status lines, in one row.

    One pass; what is shuffled is one row of counters per task.
    """
    sums = compliance_flags(df, text_col, seconds_col, threshold).agg(
        F.count("*").alias("total_items"),
        F.count_if(F.size("types") > 0).alias("items_with_pii"),
        F.count_if("is_injection").alias("items_with_injection"),
        F.coalesce(F.sum(F.size("types")), F.lit(0)).alias("pii_entities"),
        # a set of the few label sets that occur
        F.collect_set(F.array_sort(F.array_distinct("types"))).alias("_types"),
        F.avg("seconds").alias("avg_seconds"),
        F.sum("seconds").alias("total_seconds"),
    )

    def share(col: str):
        return F.expr(f"round(100.0D * {col} / nullif(total_items, 0), 1)")

    def status(col: str, none: str, some: str):
        return F.when(F.col(col) == 0, none).otherwise(
            F.concat_ws(" ", F.col(col).cast("string"), F.lit(some))
        )

    types = F.array_join(F.array_sort(F.array_distinct(F.flatten("_types"))), ",")
    return sums.withColumns(
        {
            "types_found": types,
            "pct_with_pii": share("items_with_pii"),
            "pct_with_injection": share("items_with_injection"),
            "pii_status": status("items_with_pii", NO_PII, SOME_PII),
            "injection_status": status("items_with_injection", NO_INJECTION, SOME_INJECTION),
        }
    ).drop("_types")


def stamped(report: DataFrame, column: str = "report_time") -> DataFrame:
    """The report with the time it was made, as text in UTC."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return report.withColumn(column, now)


def pii_types_found(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Occurrences by type over the table, as the report lists them."""
    return pii_type_totals(mask_pii(df, text_col))
