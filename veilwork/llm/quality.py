"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Rules that need no more than the base counts come for nothing; the others are
tried in the order that rejects most per second, as measured on a sample.  The
order changes the cost only: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from veilwork.llm.common import once, words

#: Fixed values of the base counts.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``rejects`` reads the columns ``t`` (text), ``w`` (words) and the base counts."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    """Rules for running text in any alphabetic language."""
    letters = F.length(F.regexp_replace("t", r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace("t", r"[^\p{Lu}]+", ""))
    lettered = F.size(F.filter("w", lambda x: x.rlike(r"\p{L}")))
    ends = F.length("t") - F.length(F.translate("t", "!?", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        # one or two lines again say nothing of a short text
        Rule("repeated_lines", (F.col("n_dup_lines") > 2)
             & (F.col("n_dup_lines") * 10 > F.size(F.split("t", "\n", -1)) * 3)),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words"))
             | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("shouting", capitals * 2 > letters),
        Rule("marks", ends * 2 > F.col("n_words")),
        Rule("no_letters", lettered * 10 < F.col("n_words") * 6),
    ]


def _repeat_words(w: Column, h: Column) -> Column:
    """Words in three-word windows found twice or more.

    If all window hashes differ, so do all windows.  Else windows are sorted
    (by hash first, which is cheap, then by their words) and equal neighbours
    marked: n log n steps, and exact.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(h) - 1),
        lambda i: F.struct(
            F.get(h, i).alias("h"),
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"),
            i.alias("i"),
        ),
    )

    def covered(s: Column) -> Column:
        same = lambda a, b: F.coalesce(
            (a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False)
        )
        found = F.filter(
            F.transform(
                s,
                lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"]),
            ),
            lambda p: p.isNotNull(),
        )
        spread = F.flatten(F.transform(found, lambda p: F.array(p, p + 1, p + 2)))
        return F.size(F.array_distinct(spread))

    counted = F.get(F.transform(F.array(F.array_sort(windows)), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted)


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``t``, ``w`` and the base counts of every text; null counts as empty."""
    df = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    df = once(df, "w", words(F.col("t")))
    w = F.col("w")
    hashes = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = once(df, "h", hashes)
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = once(df, "l", lines)
    blanks = " \t\n\x0b\x0c\r"
    return df.select(
        F.col("k").alias(key), "t", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", blanks, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.explode(F.array(_repeat_words(w, F.col("h")).cast("long"))).alias("n_repeat_words"),
    )


def order_rules(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text",
                sample_rows: int = 2000, fraction: float = 0.02) -> list[Rule]:
    """Rules by rejections per second on a sample of at most ``sample_rows`` rows.

    The sample chooses an order and nothing else.
    """
    sample = base_counts(docs.sample(fraction, seed=11).limit(sample_rows), key, text).persist()
    try:
        rows = sample.count()
        if not rows:
            return rules

        def run(column: Column) -> tuple[float, int]:
            best, got = float("inf"), 0
            for _ in range(2):
                started = time.perf_counter()
                got = sample.agg(F.count(F.when(column, 1)).alias("n")).first()["n"]
                best = min(best, time.perf_counter() - started)
            return best, got

        idle, _ = run(F.lit(False))
        worth = {}
        for rule in rules:
            seconds, rejected = run(rule.rejects)
            # one rejection more than seen: a rule that found none yet still has an order by cost
            worth[rule.name] = (rejected + 1) / max(seconds - idle, 1e-4)
        return sorted(rules, key=lambda r: -worth[r.name])
    finally:
        sample.unpersist()


def quality_cascade(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every document.

    Null and empty texts have no words and fail.  Rows are judged one by one:
    repeated rows come back repeated, an empty table gives an empty one, other
    columns of the table are not read.
    """
    base = base_counts(docs, key, text)
    ordered = order_rules(docs, default_rules() if rules is None else rules, key, text, sample_rows)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    verdict = F.when(failed, F.lit(False))
    for rule in ordered:
        verdict = verdict.when(rule.rejects, F.lit(False))
    return base.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), verdict.otherwise(F.lit(True)).alias("kept"),
    )
