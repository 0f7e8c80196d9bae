"""Operators that judge texts and act on the judgement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilwork import functions as vf
from veilwork.functions import injection as inj, rules, spans
from veilwork.operators.rows import add_once, fresh, quoted

DECISION_FIELDS = ("is_injection", "injection_score", "safe_score", "confidence", "classification")


def detect_prompt_injection(
    df: DataFrame,
    text_col: str = "text",
    threshold: float = rules.INJECTION_THRESHOLD,
    top_k: int = 1,
    mitigation: str = "strip",
    labels_col: str | None = None,
) -> DataFrame:
    """Add the decision fields.

    With ``top_k=1`` only the better label is known and the other score is 0,
    so a threshold below 0.5 changes nothing; ``top_k=2`` gives both scores.
    Labels come from the rules, or from ``labels_col`` where a model gave them.
    """
    if labels_col is None:
        judged = inj.judge_text(text_col, threshold, top_k, mitigation)
    else:
        judged = inj.decide(inj.fold_label_scores(labels_col), threshold)
    at = fresh("_judged", df)
    return add_once(df, at, judged).select(
        *quoted(df.columns, but=DECISION_FIELDS),
        *[F.col(f"{at}.{f}").alias(f) for f in DECISION_FIELDS],
    )


def moderate_chat(
    df: DataFrame, text_col: str = "text", threshold: float = rules.INJECTION_THRESHOLD
) -> DataFrame:
    """Status, confidence and action per chat message."""
    judged = detect_prompt_injection(df, text_col, threshold)
    return judged.withColumn(
        "action", F.when(F.col("is_injection"), "blocked and logged").otherwise("delivered")
    )


def validate_requests(
    df: DataFrame, query_col: str = "query", threshold: float = rules.INJECTION_THRESHOLD
) -> DataFrame:
    """Verdict, response and confidence per API request."""
    judged = detect_prompt_injection(df, query_col, threshold)
    bad = F.col("is_injection")
    return judged.withColumns(
        {
            "verdict": F.when(bad, "BLOCKED").otherwise("ALLOWED"),
            "response": F.when(bad, "400 Bad Request").otherwise("200 OK"),
        }
    )


def dual_filter(
    df: DataFrame,
    text_col: str = "text",
    threshold: float = rules.INJECTION_THRESHOLD,
    pii_rules=rules.PII_RULES,
) -> DataFrame:
    """Security first, then masking; blocked texts are not searched for PII.

    ``decision`` is ``blocked``, ``masked`` or ``clean``.  Clean means that
    masking left the text as it was.
    """
    judged = detect_prompt_injection(df, text_col, threshold)
    found = f"IF(is_injection, NULL, {spans.detect_entities(text_col, pii_rules)})"
    at = fresh("_found", judged)
    searched = add_once(judged, at, found)
    masked = searched.withColumn(
        "masked_text", F.when(~F.col("is_injection"), vf.apply_mask(text_col, at))
    )
    return masked.select(
        *quoted(judged.columns, but=["masked_text", "entities", "decision"]),
        "masked_text",
        F.when(~F.col("is_injection"), vf.extract_entities(at)).alias("entities"),
        F.when(F.col("is_injection"), "blocked")
        .when(F.col("masked_text") != F.col(text_col), "masked")
        .otherwise("clean")
        .alias("decision"),
    )


route = dual_filter
