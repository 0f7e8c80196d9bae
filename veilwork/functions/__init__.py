"""Column functions over SQL expressions.

Every function takes a column name, or any SQL expression as text, and returns
a ``Column``.  All run inside the JVM; none starts a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from veilwork.functions import injection as _inj, rules, spans as _spans, text as _text


def detect_entities(text: str, pii_rules=rules.PII_RULES) -> Column:
    return F.expr(_spans.detect_entities(text, pii_rules))


def resolve_spans(text: str, spans: str) -> Column:
    return F.expr(_spans.resolve_spans(text, spans))


def apply_mask(text: str, entities: str) -> Column:
    return F.expr(_spans.apply_mask(text, entities))


def extract_entities(entities: str, min_score: float = rules.ENTITY_MIN_SCORE) -> Column:
    return F.expr(_spans.extract_entities(entities, min_score))


def merge_bio(text: str, entities: str, max_gap: int = 1) -> Column:
    return F.expr(_spans.merge_bio(text, entities, max_gap))


def entity_type(label: str) -> Column:
    return F.expr(_spans.entity_type(label))


def mask_label(label: str) -> Column:
    return F.expr(_spans.mask_label(label))


def mask_pii_text(text: str, pii_rules=rules.PII_RULES) -> Column:
    return F.expr(_spans.mask_pii_text(text, pii_rules))


def score_injection(text: str, mitigation: str = "strip") -> Column:
    return F.expr(_inj.score_injection(text, mitigation=mitigation))


def fold_label_scores(labels: str) -> Column:
    return F.expr(_inj.fold_label_scores(labels))


def check_prompt_injection(text: str, threshold: float = rules.INJECTION_THRESHOLD) -> Column:
    return F.expr(_inj.check_prompt_injection(text, threshold))


def response_tier(score: str, bands=rules.RESPONSE_BANDS, otherwise=rules.RESPONSE_ELSE) -> Column:
    return F.expr(_inj.response_tier(score, bands, otherwise))


def normalize_text(text: str) -> Column:
    return F.expr(_text.normalize_text(text))


def preview(text: str, n: int) -> Column:
    return F.expr(_text.preview(text, n))


def register_functions(spark: SparkSession) -> None:
    """Make ``mask_pii_text`` and ``check_prompt_injection`` callable from SQL."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION mask_pii_text(body STRING) RETURNS STRING "
        f"RETURN {_spans.mask_pii_text('body')}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION check_prompt_injection(body STRING) RETURNS BOOLEAN "
        f"RETURN {_inj.check_prompt_injection('body')}"
    )
