"""Near-duplicates beside brute force over full sets."""

import random
import re

import pytest

from veilwork.llm import minhash
from veilwork.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(text, n):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(rows, n, percent):
    sets = [sets_of(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        smallest = min(ids) if ids else None
        out.append((key, len(sets[i]), smallest, key == smallest))
    return sorted(out, key=repr)


def run(spark, rows, n, percent):
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean").repartition(3)
    return sorted((tuple(r) for r in minhash.near_duplicates(df, n, percent).collect()), key=repr)


def edited(rng, words, share):
    return " ".join(f"e{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words)


def texts(seed, groups, size, length, share):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for g in range(groups):
        words = [f"w{rng.randint(0, 500)}" for _ in range(length)]
        out += [edited(rng, words, rng.choice([0, share, share * 2])) for _ in range(size)]
    out += [" ".join([f"w{rng.randint(0, 500)}" for _ in range(length)] + passage) for _ in range(20)]
    rng.shuffle(out)
    return out


def test_odd_rows(spark):
    rows = list(enumerate([
        None, "", " \t\n", "one", "ONE", "one two", "One Two\x0b", "a b c", "A b\nc", "a b d",
        "É x y", "é x y", "x y z", "a b c a b c a b c", "z " * 30_000, "Z " * 40_000,
    ]))
    rows += [(3, "one"), (3, "other words here"), (None, "one"), (None, "alone in null"), (None, None), (-9, "a b c")]
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)
    assert run(spark, [], 3, 85) == []
    assert run(spark, [(1, None), (2, "")], 3, 85) == brute([(1, None), (2, "")], 3, 85)


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_groups(spark, n, percent):
    rows = list(enumerate(texts(n, 6, 12, 120, 0.02)))
    assert run(spark, rows, n, percent) == brute(rows, n, percent)


def test_warm_values(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 4)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    rows = list(enumerate(texts(1, 3, 40, 60, 0.025)))
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_components(spark):
    rng = random.Random(2)
    links = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 60)] + [("100", f"{i}") for i in range(101, 140)]
    links += [(str(rng.randint(500, 560)), str(rng.randint(500, 560))) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        want[x] = min(seen)
    assert got == want


def test_large_group_of_near_copies(spark, monkeypatch):
    # few rows behind the pivot joins: one for each entry of a list, whatever the pivots
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, words, 0.012)) for i in range(500)]
    rows += [(1000 + i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(500)]
    met = []
    links = minhash._Search.links

    def counted(self, pairs):
        met.append(pairs.count())
        return links(self, pairs)

    monkeypatch.setattr(minhash._Search, "links", counted)
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)
    assert sum(met) < 60 * len(rows)  # 16 pivots a list made 650 a row


def test_edits_beyond_the_limit_meet_nothing(spark, monkeypatch):
    # near copies of one text with so many edits of their own that no two of them are linked
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]

    def apart(i, edits):
        at = set(rng.sample(range(3, 147), edits))
        return " ".join(f"x{i}y{k}" if k in at else w for k, w in enumerate(words))

    rows = [(i, apart(i, 14)) for i in range(300)] + [(1000 + i, apart(1000 + i, 1 + i % 3)) for i in range(60)]
    met, cut = [], minhash.cut

    def kept(df, name):
        out = cut(df, name)
        if "g" in out.columns:
            met.append(out.select("c").distinct().count())
        return out

    monkeypatch.setattr(minhash, "cut", kept)
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)
    assert met and max(met) <= 60  # all 360 were listed
