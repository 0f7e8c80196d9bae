"""Budgets and choices beside a plain recursion."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from veilwork.llm import mixing

LEVELS = ["domain", "lang", "source"]


def fill(children, budget):
    """children: [(sort key, weight, capacity)] -> whole shares."""
    live = sorted((c for c in children if c[1] > 0 and c[2] >= 0), key=lambda c: (Fraction(c[2], c[1]), c[0]))
    out, left, rest = {}, budget, sum(c[1] for c in live)
    open_ = []
    for k, w, cap in live:
        if cap * rest <= left * w:
            out[k] = cap
            left -= cap
        else:
            open_.append((k, w))
        rest -= w if k in out else 0
        if open_:
            break
    done = len(out) + len(open_)
    open_ += [(k, w) for k, w, _ in live[done:]]
    wide, upto = sum(w for _, w in open_), 0
    for k, w in open_:
        out[k] = left * (upto + w) // wide - left * upto // wide
        upto += w
    return out


def brute(rows, weights, share, epochs, seed):
    leaves = defaultdict(list)
    for i, (key, *path, n) in enumerate(rows):
        leaves[tuple(x or "" for x in path)].append((i, "" if key is None else str(key), n or 0))
    w = lambda path: weights.get(path, 1)

    def cap(path):
        below = {p[:len(path) + 1] for p in leaves if p[:len(path)] == path}
        own = sum(n for _, _, n in leaves[path]) * epochs if len(path) == 3 else sum(cap(p) for p in below)
        return own if not path or w(path) else 0

    supply = sum(n for v in leaves.values() for _, _, n in v)
    budgets = {(): min(int(supply * share), cap(()))}
    for depth in range(3):
        for parent in [p for p in budgets if len(p) == depth]:
            below = sorted({p[:depth + 1] for p in leaves if p[:depth] == parent})
            shares = fill([("\x01".join(p), w(p), cap(p)) for p in below], budgets[parent])
            budgets.update({p: shares.get("\x01".join(p), 0) for p in below})
    copies = [0] * len(rows)
    for path, docs in leaves.items():
        total, budget = sum(n for _, _, n in docs), budgets[path]
        full, rest = divmod(budget, total) if total else (0, 0)
        place = lambda k: (int(hashlib.md5(f"{seed}|{full}|{k}".encode()).hexdigest()[:15], 16), k)
        at = 0
        groups = defaultdict(list)
        for i, k, n in docs:
            groups[place(k)].append((i, n))
        for _, members in sorted(groups.items()):
            for i, _ in members:
                copies[i] = full + (at < rest)
            at += sum(n for _, n in members)
    return copies, {p: b for p, b in budgets.items() if len(p) == 3}, budgets[()]


def run(spark, rows, weights, share, epochs=4, seed=3):
    schema = "doc_id long, domain string, lang string, source string, n_tokens long, copies string, budget int"
    df = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], schema).repartition(3)
    out = mixing.mix_to_weights(df, LEVELS, weights, budget_share=share, max_epochs=epochs, seed=seed)
    assert out.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "budget", "copies"]
    got = {r["budget"]: r["copies"] for r in out.collect()}
    return [got[i] for i in range(len(rows))]


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice(["web"] * 6 + ["book", None]), rng.choice(["en", "de", "fr"]),
             rng.choice(["s0"] * 4 + ["s1", "s2", "s3"]), rng.choice([0, 1, 5, 50, 400])) for i in range(n)]


def test_against_recursion(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 8)
    rows = rows_of(1, 400)
    weights = {("web",): 1, ("book",): 9, ("book", "en"): 5, ("web", "de"): 0, ("web", "en", "s1"): 7}
    for share in (0.4, 1.7):
        want, budgets, total = brute(rows, weights, share, 4, 3)
        assert sum(budgets.values()) == total
        assert run(spark, rows, weights, share) == want


def test_nulls_ties_and_nothing(spark):
    rows = [(None, None, None, None, None), (1, "a", "b", "c", 3), (1, "a", "b", "c", 3), (1, "a", "b", "c", 4),
            (None, "a", "b", "c", 5), (2, "a", "b", "c", None), (3, "a", "", "c", 10)]
    assert run(spark, rows, {}, 0.5) == brute(rows, {}, 0.5, 4, 3)[0]
    assert run(spark, rows, {("a",): 0}, 0.5) == [0] * len(rows)
    assert run(spark, [], {}, 0.5) == []


def test_own_names_of_columns(spark):
    names = ["row", "own", "leaf_0", "leaf_1", "epochs", "cut_u", "cut_key", "_leaf_0", "_epochs", "_cut_u", "_cut_key", "copies"]
    kind = "doc_id long, n_tokens long, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, 10, "en" if i % 3 else "de", f"s{i % 4}", *[f"mine {n}" for n in names]) for i in range(60)]
    docs = spark.createDataFrame(rows, kind)
    chosen = lambda df: mixing.mix_to_weights(df, ["lang", "source"], {("en",): 2}, budget_share=0.5)
    got = chosen(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        assert [r[n] for n in names[:-1]] == [f"mine {n}" for n in names[:-1]]
    copies = lambda df: sorted((r["doc_id"], r["copies"]) for r in df.collect())
    assert copies(got) == copies(chosen(docs.select("doc_id", "n_tokens", "lang", "source")))
    assert sum(c for _, c in copies(got)) > 0
