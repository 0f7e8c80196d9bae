"""Top-k search beside plain loops."""

import math
import random

from veilwork.llm.topk import top_k

KINDS = "vec_id long, embedding array<float>, score long"


def brute(rows, every, k):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in usable:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable
                        if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, every=10, k=3, **more):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], KINDS).repartition(3)
    return sorted(tuple(r) for r in top_k(df, every, k, **more).collect())


def test_random_ties_and_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-2, 2) / 2 for _ in range(12)]) for i in range(150)]
    rows += rows[:20] + [(200 + i, rows[5][1]) for i in range(8)]
    assert run(spark, rows) == brute(rows, 10, 3)
    assert run(spark, rows, every=2, k=7, block=16) == brute(rows, 2, 7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (10, None), (20, [None, 1.0]), (30, [nan, 1.0]), (40, [inf, 0.0]),
            (None, [1.0, 1.0]), (1, [0.5, 0.25]), (2, []), (50, []), (3, [1.0]), (60, [-1e12, 1e12]),
            (4, [1e30, -1e30])]
    rows = [(i, v) for i, v in rows]
    got = run(spark, rows)
    import struct
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    exact = [(i, v if v is None else [x if x is None else single(x) for x in v]) for i, v in rows]
    limit = 2**63 - 1
    clip = lambda x: max(-limit, min(limit, x))
    usable = [(i, [clip(math.floor(1024 * x)) for x in v]) for i, v in exact
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in usable:
        if q % 10 == 0:
            s = sorted((-clip(sum(a * b for a, b in zip(v, w))), i) for i, w in usable
                       if i != q and len(w) == len(v))
            want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:3])]
    assert got == sorted(want)
    assert run(spark, []) == []
