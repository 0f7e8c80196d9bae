"""The audit of sources beside plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest

from veilwork.llm import divergence

KINDS = "doc_id long, text string, lang string, source string, term string, ordinal long, part long"


def brute(docs, least_docs, top=50):
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = ["".join(c.lower() if c.isascii() else c for c in t) for t in terms]
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least_docs)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(of):
            total = sum(of[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (of[t] + 5) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(rows)]
    return sorted(out)


def corpus(seed, n=240):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abCé的𝄞", k=rng.randint(1, 4))) for _ in range(60)]
    docs = []
    for i in range(n):
        source = "hot" if rng.random() < 0.5 else f"s{rng.randint(0, 6)}"
        text = rng.choice([" ", "-", "7\n", "`@[{\x7f"]).join(rng.choices(words, k=rng.randint(0, 30)))
        docs.append((text, rng.choice(["en", "de", "de"]), source))
    return docs


def run(spark, docs, **more):
    rows = [(i, t, la, s, "mine", 1, 2) for i, (t, la, s) in enumerate(docs)]
    got = divergence.audit_sources(spark.createDataFrame(rows, KINDS).repartition(3), **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


def test_as_brute_force(spark):
    docs = corpus(1)
    got = run(spark, docs, least_docs=12, top=5)
    assert got == brute(docs, 12, 5)
    assert {r[2] for r in got} == {"pair", "term"}


def test_in_small_pieces(spark, monkeypatch):
    # many blocks, a broadcast for each, handed on after each text, tiles of two sources
    docs = corpus(2)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 60)
    monkeypatch.setattr(divergence, "PACK_BYTES", 3000)
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "TERMS", 7)
    monkeypatch.setattr(divergence, "TILE", 2)
    assert run(spark, docs, least_docs=3) == brute(docs, 3)


def test_nulls_ties_and_no_terms(spark):
    docs = [("b a", None, None), ("a b", None, "x"), (None, "en", "x"), ("", "en", None), ("c C c", "fr", "x"),
            ("c", "fr", "x"), ("123 ---", "fr", "y"), ("a b", None, "x")]
    got = run(spark, docs, least_docs=2)
    assert got == brute(docs, 2)
    # no kept term in en: its groups are 0 apart
    assert [r for r in got if r[0] == "en"] == [("en", "", "pair", "x", 0, 1), ("en", "x", "pair", "", 0, 1)]


def test_long_text(spark):
    docs = [("word " * 200_000 + "x" * 300_000, "en", "a"), ("word other " * 3, "en", "b"), ("other " + "x" * 300_000, "en", "b")]
    assert run(spark, docs, least_docs=2) == brute(docs, 2)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("text, terms", [
    (b"Ab-c\xc3\x89 x9y", [b"ab", b"c\xc3\x89", b"x", b"y"]), (b"", []), (None, []), (b" \n", []),
])
def test_terms(text, terms):
    assert divergence.terms_of(text) == terms


def test_blocks_find_their_terms():
    words = sorted({bytes([97 + i % 7, 97 + i % 5, 97 + i % 3]) for i in range(105)})
    parts = [(words[i], i, divergence.compile_words({w: [] for w in words[i:i + 10]})) for i in range(0, len(words), 10)]
    found = divergence.Ordinals(parts).find([*words, b"", b"zzz", b"aa", b"aaaa"])
    assert found.tolist() == [*range(len(words)), -1, -1, -1, -1]


def test_queries_twin(spark):
    from checks.compare import compare, connect
    from veilwork.llm import queries

    name, sf = "op13_source_divergence", "/root/testdata/sf0.001"
    verdict = compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.ORACLES[name])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
