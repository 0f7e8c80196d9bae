"""Prompt-injection scoring and decisions, as SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from veilwork.functions import rules
from veilwork.functions.rules import InjectionRule
from veilwork.functions.sqltext import any_of, holds, let, lit


def rule_hit(text: str, rule: InjectionRule) -> str:
    hit = f"rlike({text}, {lit(rule.regex)})"
    return f"{holds(text, rule.needs)} AND {hit}" if rule.needs else hit


def score_injection(
    text: str,
    injection_rules: Sequence[InjectionRule] = rules.INJECTION_RULES,
    mitigation: str = "strip",
) -> str:
    """Noisy-or of the rules that match: 1 - product of (1 - weight).

    ``mitigation`` says what a quoted attack phrase does: ``strip`` takes only
    the quoted phrase out before scoring, ``zero`` sets the whole score to 0
    (also for a how-to-defend question), ``off`` does nothing.  ``zero`` can
    be abused: an attacker only has to add the phrase.
    """
    if mitigation not in ("strip", "zero", "off"):
        raise ValueError("mitigation must be 'strip', 'zero' or 'off'")
    seen = f"regexp_replace({text}, {lit(rules.UNSEEN)}, '')"
    low = f"lower(regexp_replace({seen}, {lit(rules.BLANKS)}, ' '))"
    if mitigation == "strip":
        cut = f"regexp_replace(q, {lit(rules.QUOTED_PHRASE)}, ' ')"
        low = let("q", low, f"IF(contains(q, {lit(rules.QUOTABLE)}), {cut}, q)")
    miss = " * ".join(
        f"IF({rule_hit('t', r)}, 1D - {r.weight}D, 1D)" for r in injection_rules
    )
    score = f"1D - {miss}"
    if mitigation == "zero":
        quiet = f"rlike(t, {lit(rules.QUOTED_PHRASE)}) OR rlike(t, {lit(rules.ASKING_FOR_HELP)})"
        score = f"IF({quiet}, 0D, {score})"
    if all(r.needs for r in injection_rules):
        # most texts hold none of the words, and one scan says so
        words = [w for r in injection_rules for w in r.needs]
        firsts = rules.one_of("".join(w[0] for w in words))
        scan = lit(rf"\W(?={firsts})(?:{'|'.join(dict.fromkeys(words))})")
        score = f"IF(rlike(concat(' ', t), {scan}), {score}, 0D)"
    return f"coalesce({let('t', low, score)}, 0D)"


def injection_labels(score: str, top_k: int = 1) -> str:
    """A label response for a score: the better label, or both, best first."""
    both = (
        f"array_sort(array(named_struct('label', 'INJECTION', 'score', {score}), "
        f"named_struct('label', 'SAFE', 'score', 1D - {score})), "
        "(a, b) -> CASE WHEN a.score > b.score THEN -1 WHEN a.score < b.score THEN 1 ELSE 0 END)"
    )
    return f"slice({both}, 1, {int(top_k)})"


def label_score(labels: str, names: Sequence[str]) -> str:
    """Score of the last entry whose label is one of ``names``, else 0."""
    chosen = f"filter({labels}, e -> upper(e.label) IN ({any_of(names)}))"
    return f"coalesce(try_element_at({chosen}, -1).score, 0D)"


def fold_label_scores(labels: str) -> str:
    """Struct of injection_score and safe_score."""
    return (
        f"named_struct('injection_score', {label_score(labels, rules.INJECTION_LABELS)}, "
        f"'safe_score', {label_score(labels, rules.SAFE_LABELS)})"
    )


def decide(folded: str, threshold: float = rules.INJECTION_THRESHOLD) -> str:
    """Decision fields for folded scores; the threshold itself is still safe."""
    return let(
        "s",
        folded,
        f"named_struct('is_injection', s.injection_score > {threshold}D, "
        "'injection_score', s.injection_score, 'safe_score', s.safe_score, "
        "'confidence', greatest(s.injection_score, s.safe_score), "
        f"'classification', IF(s.injection_score > {threshold}D, "
        f"'{rules.CLASS_INJECTION}', '{rules.CLASS_SAFE}'))",
    )


def judge_text(
    text: str,
    threshold: float = rules.INJECTION_THRESHOLD,
    top_k: int = 1,
    mitigation: str = "strip",
) -> str:
    """Score a text with the rules and decide, in one struct."""
    scored = score_injection(text, mitigation=mitigation)
    return decide(
        let("sc", scored, fold_label_scores(injection_labels("sc", top_k))), threshold
    )


def check_prompt_injection(
    text: str, threshold: float = rules.INJECTION_THRESHOLD, mitigation: str = "strip"
) -> str:
    return f"{judge_text(text, threshold, mitigation=mitigation)}.is_injection"


def response_tier(score: str, bands=rules.RESPONSE_BANDS, otherwise=rules.RESPONSE_ELSE) -> str:
    """Name of the highest band the score lies above."""
    steps = sorted(bands, reverse=True)
    arms = " ".join(f"WHEN {score} > {low}D THEN {lit(name)}" for low, name in steps)
    return f"CASE {arms} ELSE {lit(otherwise)} END"
