"""Span matching, threshold curves and stored answers beside plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from veilwork.operators import answers, ranges, span_eval, thresholds

SPAN = "array<struct<label:string,start:int,end:int>>"


def disjoint(rng, n, gap):
    out, at = [], 0
    for _ in range(n):
        at += rng.randint(0, gap)
        end = at + rng.randint(0, 9)
        out.append((rng.choice("AB"), at, end))
        at = end
    return out


def nudged(rng, spans):
    out, last = [], {}
    for label, a, b in spans:
        if rng.random() < 0.2:
            continue
        a, b = a + rng.randint(-2, 2), b + rng.randint(-2, 2)
        a = max(a, last.get(label, 0))
        if b >= a:
            out.append((label, a, b))
            last[label] = b
    return out


def alike(x, y, least):
    shared = min(x[2], y[2]) - max(x[1], y[1])
    return x[0] == y[0] and shared > 0 and shared > least * (max(x[2], y[2]) - min(x[1], y[1]))


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_matches_as_all_pairs(spark, least):
    rng = random.Random(6)
    texts = []
    for i in range(60):
        expected = disjoint(rng, rng.randint(0, 30), 6)
        texts.append((i, expected, nudged(rng, expected), "mine"))
    texts += [(100, None, [("A", 0, 3)], ""), (101, [("A", 0, 3), ("A", 0, 3)], None, ""), (102, [], [], "")]
    df = spark.createDataFrame(texts, f"id int, expected {SPAN}, found {SPAN}, side string")
    got = span_eval.match_spans(df, "id", "expected", "found", least).collect()
    want = []
    for i, expected, found, _ in texts:
        a, b = set(expected or []), set(found or [])
        want += [(i, "expected", *x, any(alike(x, y, least) for y in b), x in b and x[2] > x[1]) for x in a]
        want += [(i, "found", *y, any(alike(x, y, least) for x in a), y in a and y[2] > y[1]) for y in b]
        # one to one
        assert all(sum(alike(x, y, least) for y in b) < 2 for x in a)
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert any(r["matched"] and not r["exact"] for r in got)


def test_scores(spark):
    rows = [("A", "expected", True, True), ("A", "found", True, True), ("A", "found", False, False), ("B", "expected", False, False)]
    df = spark.createDataFrame(rows, "label string, side string, matched boolean, exact boolean")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in span_eval.span_scores(df).collect()}
    assert got == {"A": (0.5, 1.0, 2 / 3), "B": (None, 0.0, 0.0), "overall": (0.5, 0.5, 0.5)}
    assert span_eval.span_scores(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        span_eval.match_spans(df, "label", "x", "y", 0.4)


def test_curve_as_plain(spark):
    rng = random.Random(3)
    rows = [(round(rng.gauss(y, 1), 1), bool(y)) for y in rng.choices([0, 1], [3, 1], k=800)]
    df = spark.createDataFrame([*rows, (None, True), (0.5, None), (float("nan"), False)], "s double, y boolean")
    curve = thresholds.threshold_curve(thresholds.score_counts(df, "s", "y").repartition(4))
    got = sorted((r["threshold"], r["tp"], r["fp"], r["fn"], r["tn"]) for r in curve.collect())
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    of = lambda xs, t: sum(x >= t for x in xs)
    assert got == [
        (t, of(pos, t), of(neg, t), len(pos) - of(pos, t), len(neg) - of(neg, t)) for t in sorted({s for s, _ in rows})
    ]
    summary = thresholds.curve_summary(curve).first()
    pairs = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert summary["auc"] == pytest.approx(pairs / len(pos) / len(neg))
    f1 = {t: 2 * tp / (2 * tp + fp + fn) for t, tp, fp, fn, _ in got}
    assert summary["best_f1"] == pytest.approx(max(f1.values()))
    assert summary["f1_threshold"] == max(t for t, v in f1.items() if v == max(f1.values()))


def test_curve_of_one_label_or_none(spark):
    df = spark.createDataFrame([(0.5, True), (0.7, True)], "s double, y boolean")
    one = thresholds.curve_summary(thresholds.threshold_curve(thresholds.score_counts(df, "s", "y"))).first()
    assert one["auc"] is None and one["average_precision"] == 1.0
    none = thresholds.threshold_curve(thresholds.score_counts(df.limit(0), "s", "y"))
    assert none.collect() == [] and thresholds.curve_summary(none).first()["auc"] is None


def test_totals_before(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 9), rng.choice("xy"), rng.choice([1, 2, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, g string, v int").repartition(6)
    order = [F.col("k"), F.col("id")]
    dealt = ranges.dealt_by_range(df, order, parts=7)
    assert dealt.select("part").distinct().count() > 1
    got = ranges.with_totals_before(dealt, order, {"n": F.lit(1), "total": F.col("v")}, by=["g"])
    assert got.columns == ["id", "k", "g", "v", "n", "total"]
    for r in got.collect():
        before = [x for x in rows if x[2] == r["g"] and (x[1], x[0]) < (r["k"], r["id"])]
        assert (r["n"], r["total"]) == (len(before), sum(x[3] or 0 for x in before))


def test_answers_outlive_a_run(spark, tmp_path):
    store = str(tmp_path / "store")
    called = spark.sparkContext.accumulator(0)
    kind = "id int, text string, answer string, text_digest string, row int"
    rows = lambda texts: spark.createDataFrame([(i, t, "mine", "mine", 3) for i, t in enumerate(texts)], kind)

    def scorer(new):
        assert new.columns == ["text_digest", "text"]
        called.add(new.count())
        return new.where("text <> 'later'").withColumn("n", F.length("text"))

    def run(texts, version):
        got = answers.score_with_store(rows(texts), scorer, store, version, "id")
        assert got.columns == ["id", "text", "text_digest", "row", "answer", "reused"]
        before, called.value = called.value, 0
        return sorted((r["id"], r["answer"], r["reused"]) for r in got.collect()), before

    n = lambda k: f'{{"n":{k}}}'
    first, calls = run(["a", "bb", "a", None, "later", ""], "1")
    assert calls == 4
    assert first == [(0, n(1), False), (1, n(2), False), (2, n(1), False), (3, None, None), (4, None, None), (5, n(0), False)]
    again, calls = run(["a", "ccc", "later", "bb"], "1")
    assert calls == 2  # the new text, and the one without an answer
    assert again == [(0, n(1), True), (1, n(3), False), (2, None, None), (3, n(2), True)]
    assert run(["a", "ccc"], "1") == ([(0, n(1), True), (1, n(3), True)], 0)
    # "01" is another version than "1"
    assert run(["a"], "01") == ([(0, n(1), False)], 1)


def test_failed_run_leaves_the_store(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "a")], "id int, text string")

    def broken(new):
        return new.withColumn("n", F.raise_error(F.lit("no answer")))

    with pytest.raises(Exception, match="no answer"):
        answers.score_with_store(df, broken, store, "1", "id")
    assert answers.stored_answers(spark, store, "1") is None
    done = answers.score_with_store(df, lambda new: new.withColumn("n", F.lit(1)), store, "1", "id")
    assert done.first()["answer"] == '{"n":1}'
