"""Thresholds from data: exact ROC and precision-recall curves of a scorer, and areas under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilwork.operators.ranges import dealt_by_range, with_totals_before


def score_counts(df: DataFrame, score: str, positive: Column | str) -> DataFrame:
    """(score, n_pos, n_neg) of each distinct score; rows without score or label are left out.

    Tasks add up equal scores first; it is the one shuffle of the rows, and of
    two columns of them.
    """
    truth = F.expr(positive) if isinstance(positive, str) else positive
    rows = df.select(F.col(f"`{score}`").cast("double").alias("score"), truth.cast("boolean").alias("y"))
    known = rows.where("score IS NOT NULL AND NOT isnan(score) AND y IS NOT NULL")
    return known.groupBy("score").agg(F.count_if("y").alias("n_pos"), F.count_if(~F.col("y")).alias("n_neg"))


def threshold_curve(counts: DataFrame) -> DataFrame:
    """One row per distinct score as threshold (at or above it is positive): tp, fp, fn, tn,
    precision, recall, fpr, f1 and youden, with the areas that the step to it adds.

    Scores that are equal are one step, so ties are right: ``auc_step`` is a
    trapezoid of the ROC curve, ``ap_step`` precision times the recall that is
    won.  Totals above a score are prefix sums over ranges of the scores; no
    task holds all of them.
    """
    order = [F.desc("score")]
    dealt = dealt_by_range(counts, order, "thresholds")
    above = with_totals_before(dealt, order, {"tp_above": F.col("n_pos"), "fp_above": F.col("n_neg")})
    totals = dealt.agg(F.coalesce(F.sum("n_pos"), F.lit(0)), F.coalesce(F.sum("n_neg"), F.lit(0))).first()
    p, n = (F.lit(v).cast("long") for v in totals)
    tp, fp = F.col("tp_above") + F.col("n_pos"), F.col("fp_above") + F.col("n_neg")
    curve = above.select(
        F.col("score").alias("threshold"), "n_pos", "n_neg", "tp_above", tp.alias("tp"), fp.alias("fp"),
        (p - tp).alias("fn"), (n - fp).alias("tn"), p.alias("p"), n.alias("n"),
    )
    return curve.selectExpr(
        "threshold", "tp", "fp", "fn", "tn", "tp / (tp + fp) AS precision", "tp / nullif(p, 0) AS recall",
        "fp / nullif(n, 0) AS fpr", "2.0D * tp / (2 * tp + fp + fn) AS f1",
        "tp / nullif(p, 0) - fp / nullif(n, 0) AS youden",
        "n_neg * (tp_above + n_pos / 2) / nullif(CAST(p AS double) * n, 0) AS auc_step",
        "(n_pos / nullif(p, 0)) * (tp / (tp + fp)) AS ap_step",
    )


def curve_summary(curve: DataFrame, least_precision: float = 0.9) -> DataFrame:
    """One row: areas under the ROC (``auc``) and the precision-recall curve (``average_precision``),
    the thresholds of the best F1 and of the best Youden index (ties: the higher threshold), and
    the one of the most recall with at least ``least_precision`` (ties: the higher; NULL if none)."""
    best = lambda by, test=None: F.max(
        F.when(F.lit(True) if test is None else test, F.struct(F.col(by).alias("v"), "threshold")))
    return curve.agg(
        F.sum("auc_step").alias("auc"), F.sum("ap_step").alias("average_precision"),
        best("f1").alias("f"), best("youden").alias("y"),
        best("recall", F.col("precision") >= least_precision).alias("r"),
    ).select(
        "auc", "average_precision", F.col("f.threshold").alias("f1_threshold"), F.col("f.v").alias("best_f1"),
        F.col("y.threshold").alias("youden_threshold"), F.col("y.v").alias("best_youden"),
        F.col("r.threshold").alias("precise_threshold"), F.col("r.v").alias("precise_recall"),
    )
