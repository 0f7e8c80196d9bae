"""Spelling variants beside plain loops over all pairs."""

import random
import re
import zlib
from collections import Counter

from veilwork.llm import spelling

KINDS = "doc_id long, text string, word string, k long"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def brute(docs, least_size=6, least_count=5, ratio=5):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 199 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1:]
            counts[low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_size and c >= least_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def run(spark, docs, **more):
    df = spark.createDataFrame([(i, t, "mine", 1) for i, t in docs], KINDS).repartition(3)
    return sorted(tuple(r) for r in spelling.spelling_variants(df, **more).collect())


def typos(rng, word, letters):
    at = rng.randrange(len(word))
    return rng.choice([
        word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:],
        word[:at] + rng.choice(letters) + word[at + 1:],
    ])


def corpus(seed, n=300, letters="abéÿ"):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(5, 13))) for _ in range(25)]
    docs = []
    for i in range(n):
        words = [rng.choice(base) for _ in range(rng.randint(0, 60))]
        words = [typos(rng, w, letters) if rng.random() < 0.2 else w for w in words]
        docs.append((i, rng.choice([" ", "-", "\n", "'9"]).join(w.title() if rng.random() < 0.1 else w for w in words)))
    return docs


def test_as_brute_force(spark):
    docs = corpus(1)
    assert run(spark, docs) == brute(docs)


def test_crowded_chunks(spark, monkeypatch):
    # every chunk is crowded, so all levels are gone through
    monkeypatch.setattr(spelling, "CROWDED", 0.01)
    docs = corpus(3, 150)
    expected = brute(docs, least_size=2, least_count=2)
    assert any(r[1] for r in expected)
    assert run(spark, docs, least_size=2, least_count=2) == expected


def test_hot_words_and_chains(spark):
    # one word has most rows; forms lead from one to the next
    docs = [(1, "aaaaaaa " * 6), (2, "aaaaaab " * 30), (3, "aaaaabb " * 150), (4, "aaaabbb " * 4000)] * 2
    got = run(spark, docs)
    assert got == brute(docs)
    assert {r[2] for r in got if r[3] >= 8} == {"aaaabbb"}


def test_ties_repeats_nulls(spark):
    # two near words of one count: the smaller is the form; repeated rows count twice
    docs = [(1, "abcdef " * 5), (2, "abcdeg " * 25), (3, "abcdeh " * 25), (3, "abcdeh"), (2, "abcdeg"),
            (None, "abcdefx " * 5), (7, None), (8, ""), (9, " \t"), (9, "×÷×÷×÷ " * 6)]
    got = run(spark, docs)
    assert got == brute(docs)
    assert next(r for r in got if r[0] == "abcdef")[1] == "abcdeg"


def test_long_words(spark):
    long = "ab" * 4_000
    docs = [(i, f"{long} {long}c {long[:-2]}ba") for i in range(6)]
    got = run(spark, docs)
    assert got == brute(docs)
    # the other two differ by two edits
    assert max(r[4] for r in got) == 1


def test_empty_table(spark):
    assert run(spark, []) == []


def test_queries_twin(spark):
    from checks.compare import compare, connect
    from veilwork.llm import queries

    name, sf = "op11_spelling_variants", "/root/testdata/sf0.001"
    verdict = compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.ORACLES[name])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
