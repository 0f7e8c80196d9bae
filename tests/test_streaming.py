"""Streams whose rows are all accounted for, tables that take each row once, sketches that merge,
and rollouts by date, beside plain loops."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from veilwork.operators import model, rollout, sketches
from veilwork.streaming import accounts, retries, sinks

UTC = timezone.utc
START = datetime(2024, 1, 1, tzinfo=UTC)
KIND = "i int, ts timestamp, latency double, is_error boolean, v string"


def calls(spark, rows):
    return spark.createDataFrame([(i, None if s is None else START + timedelta(seconds=s), x, e, v) for i, s, x, e, v in rows], KIND)


def windows(df):
    return sorted(
        (r["window_start"].timestamp() - r["window_start"].timestamp() % 600, r["v"], r["n_calls"], r["n_errors"], r["p50"], r["provisional"])
        for r in df.collect()
    )


def test_every_call_is_accounted_for(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(k * 1000 + i, rng.randint(0, 1500) + 1200 * k, float(rng.randint(1, 99)), rng.random() < 0.2, rng.choice("ab"))
                for i in range(150)] for k in range(4)]
    batches[2] += [(9001, None, 1.0, False, "a"), (9002, 5, None, True, "b")]
    path, state, source = (str(tmp_path / n) for n in ("out", "state", "in"))
    late, kept, latest = [], [], None
    for rows in batches:
        calls(spark, rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        # a new run each time: state comes from the tables and the checkpoint
        accounts.write_accounts(stream, path, state, "10 minutes", "5 minutes", by=("v",), available_now=True).awaitTermination()
        for r in rows:
            gone = r[1] is None or latest is not None and r[1] // 600 * 600 + 600 <= latest - 300
            (late if gone else kept).append(r)
        latest = max([r[1] for r in rows if r[1] is not None] + ([latest] if latest is not None else []))
    assert late
    assert sorted(r["i"] for r in accounts.read_late(spark, path).collect()) == sorted(r[0] for r in late)
    groups = {}
    for r in kept:
        groups.setdefault((r[1] // 600 * 600, r[4]), []).append(r)
    want = []
    for (w, v), rows in groups.items():
        values = sorted(r[2] for r in rows if r[2] is not None)
        p50 = values[math.ceil(0.5 * len(values)) - 1]
        want.append((w + START.timestamp(), v, len(rows), sum(r[3] for r in rows), p50, w + 600 > latest - 300))
    got = windows(accounts.read_accounts(spark, path))
    assert got == sorted(want)
    assert {g[-1] for g in got} == {True, False}
    total = sum(g[2] for g in got) + accounts.read_late(spark, path).count()
    assert total == sum(map(len, batches))


def test_a_batch_that_is_tried_again_counts_once(spark, tmp_path):
    path, state, source = (str(tmp_path / n) for n in ("out", "state", "in"))
    put = {}

    class Writer:
        def foreachBatch(self, f):
            put["f"] = f
            return self

        option = trigger = lambda self, *a, **k: self
        start = lambda self: None

    class Stream:
        writeStream = Writer()

    accounts.write_accounts(Stream(), path, state, "10 minutes", "5 minutes", by=("v",))
    one = calls(spark, [(1, 10, 1.0, False, "a"), (2, 700, 2.0, True, "a")])
    two = calls(spark, [(3, 5000, 3.0, False, "a"), (4, 20, 9.0, False, "b")])
    for batch, number in ((one, 0), (two, 1), (two, 1), (calls(spark, []), 2)):
        put["f"](batch, number)
    assert sum(r["n_calls"] for r in accounts.read_accounts(spark, path).collect()) == 4
    put["f"](calls(spark, [(5, 30, 1.0, False, "a")]), 3)
    assert sum(r["n_calls"] for r in accounts.read_accounts(spark, path).collect()) == 4
    assert [r["i"] for r in accounts.read_late(spark, path).collect()] == [5]

    sinks.write_tables(Stream(), path + "2", state, {"odd": (F.col("i") % 2 == 1, ["i"]), "all": (F.lit(True), ["i", "v"])})
    for batch, number in ((one, 0), (two, 1), (two, 1)):
        put["f"](batch, number)
    table = lambda name: sorted(r["i"] for r in sinks.read_table(spark, path + "2", name).collect())
    assert (table("odd"), table("all")) == ([1, 3], [1, 2, 3, 4])
    # a batch of which one table is written, but not the other
    calls(spark, [(7, 1, 1.0, False, "a")]).select("i").write.parquet(path + "2/odd/batch=2")
    assert (table("odd"), table("all")) == ([1, 3], [1, 2, 3, 4])


def test_sketches_merge(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 86_400 * 3), rng.lognormvariate(2, 1), rng.random() < 0.1, "a" if i % 3 else "b") for i in range(30_000)]
    rows += [(-1, 5, None, False, "c"), (-2, 6, None, True, "c")]
    for k in (512, 32_768):
        stored = sketches.latency_sketches(calls(spark, rows), by=("v",), k=k)
        assert stored.count() > 100
        for r in sketches.merge_sketches(stored, ["v"], k).collect():
            values = sorted(x[2] for x in rows if x[4] == r["v"] and x[2] is not None)
            assert r["n_calls"] == sum(x[4] == r["v"] for x in rows) and r["n_samples"] == len(values)
            if not values:
                assert (r["p50"], r["mean_latency"], r["error_rate"]) == (None, None, 0.5)
                continue
            assert r["rank_error"] == (0 if len(values) <= k else sketches.rank_error(k))
            for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
                low, high = (max(0.0, min(1.0, q + s * 1.5 * r["rank_error"])) for s in (-1, 1))
                assert values[max(math.ceil(low * len(values)) - 1, 0)] <= r[name] <= values[max(math.ceil(high * len(values)) - 1, 0)]


WEIGHTS = "valid_from timestamp, variant string, weight double"


def at(day):
    return START + timedelta(days=day)


def test_rollout_follows_the_table(spark):
    df = calls(spark, [(i, (i % 400) * 1000 + 86_400, 1.0, False, "mine") for i in range(8000)] + [(-1, None, 1.0, False, "mine"), (-2, 5, 1.0, False, "mine")])
    weights = spark.createDataFrame([
        (at(1), "a", 80.0), (at(1), "b", 20.0), (at(3.5), "a", 50.0), (at(3.5), "b", 50.0), (at(3.5), "c", None),
        (at(5), "a", 0.0), (at(90), "b", 1.0), (None, "x", 1.0)], WEIGHTS)
    got = rollout.assign_rollout(df, weights, "i", out="v")
    assert got.columns == ["i", "ts", "latency", "is_error", "v"]
    rows = {r["i"]: r for r in got.collect()}
    assert len(rows) == 8002 and rows[-1]["v"] is None and rows[-2]["v"] is None
    span = lambda a, b: [r["v"] for r in rows.values() if r["ts"] and at(a) <= r["ts"].astimezone(UTC) < at(b)]
    assert abs(span(1, 3.5).count("a") / len(span(1, 3.5)) - 0.8) < 0.03
    assert abs(span(3.5, 5).count("a") / len(span(3.5, 5)) - 0.5) < 0.03
    assert set(span(5, 9)) == {None}


def test_keys_move_only_as_weights_demand(spark):
    df = spark.createDataFrame([(k, at(d)) for k in range(1500) for d in (1, 2, 3)], "i int, ts timestamp")
    weights = spark.createDataFrame([
        (at(1), "a", 60.0), (at(1), "b", 30.0), (at(1), "c", 10.0),
        (at(2), "a", 60.0), (at(2), "b", 30.0), (at(2), "c", 50.0), (at(3), "a", 60.0), (at(3), "b", 30.0)], WEIGHTS)
    of = {(r["i"], r["ts"].astimezone(UTC)): r["variant"] for r in rollout.assign_rollout(df, weights, "i").collect()}
    first, second, third = ([of[k, at(d)] for k in range(1500)] for d in (1, 2, 3))
    assert all(y in (x, "c") for x, y in zip(first, second)) and first != second
    assert all(x == y or x == "c" for x, y in zip(second, third)) and "c" not in third


@pytest.mark.parametrize("rows", [[], [(at(1), "a", 1.0)]])
def test_rollout_of_nothing(spark, rows):
    weights = spark.createDataFrame(rows, WEIGHTS)
    assert rollout.assign_rollout(calls(spark, []), weights, "i").collect() == []
    some = rollout.assign_rollout(calls(spark, [(1, 86_400 * 2, 1.0, False, "x")]), weights, "i").collect()
    assert [r["variant"] for r in some] == (["a"] if rows else [None])


def test_retries_across_batches(spark, tmp_path):
    path, state, source, seen = (tmp_path / n for n in ("out", "state", "in", "seen"))
    seen.mkdir()
    kind = "id int, text string, tries string, label string"

    def make_model():
        import os

        def score(texts):
            out = []
            for t in texts:
                at = f"{seen}/{t.replace(' ', '-')}"
                with open(at, "a") as file:
                    file.write("x")
                if os.path.getsize(at) <= int(t.split()[-1]):
                    raise RuntimeError(f"not yet {t}")
                out.append(t)
            return out

        return score

    waited = []
    policy = model.RetryPolicy(max_retries=3, delay=30.0, backoff=2.0)
    run = retries.Retries(str(path), "text", make_model, batch_size=1, retry=policy)
    rows = [(i, f"r{i} fails {i % 6}", "mine", "mine") for i in range(18)] + [(99, None, "mine", "mine")]
    for part in (rows[:9], rows[9:]):
        spark.createDataFrame(part, kind).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(kind).parquet(str(source))
        run.write(stream, str(state), available_now=True).awaitTermination()
    assert run.answered(spark).count() == 4  # those that fail never, and the one without a text
    monkey = iter([40, 110, 400] + [4000] * 9)
    real = retries.time.time
    try:
        shift = [0.0]
        retries.time.time = lambda: real() + shift[0]

        def sleep(seconds):
            waited.append(seconds)
            shift[0] += max(seconds, 0) + next(monkey)

        run.drain(spark, sleep)
    finally:
        retries.time.time = real
    assert waited
    ok = {r["id"]: r for r in run.answered(spark).collect()}
    dead = {r["id"]: r for r in run.dead(spark).collect()}
    assert sorted([*ok, *dead]) == sorted(r[0] for r in rows)
    assert len(ok) + len(dead) == run.answered(spark).count() + run.dead(spark).count()
    for i, text, *_ in rows:
        fails = 0 if text is None else int(text.split()[-1])
        assert (i in ok) == (fails <= 3), i
        if i in dead:
            assert dead[i]["error"] == f"not yet {text}"
    sizes = {p.name: len(p.read_text()) for p in seen.iterdir()}
    assert sizes == {t.replace(" ", "-"): min(int(t.split()[-1]), 3) + 1 for _, t, *_ in rows if t}


@pytest.mark.parametrize("name, shown", [
    ("stream_filter", ["conv_id", "turn", "decision"]), ("stream_moderate", ["conv_id", "turn", "action"]),
    ("stream_retry", ["conv_id", "turn", "tries", "status"]), ("stream_tables", ["conv_id", "turn", "decision"]),
])
def test_tables_of_one_file_or_of_many(spark, tmp_path, name, shown):
    rows = [(c, t, "user", "word " * (c + t) + ("mail a@b.com" if c % 3 else "")) for c in range(6) for t in range(2)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    table.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "file" / "conversations.parquet")
    got = [sorted(map(tuple, QUERIES[name](spark, str(tmp_path / kind)).select(*shown).collect())) for kind in ("file", "folder")]
    assert got[0] == got[1]
    assert [r[:2] for r in got[0]] == [r[:2] for r in sorted(rows)]
