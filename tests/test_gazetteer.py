"""Names of a table in texts, beside a plain search."""

import random

from veilwork.operators import gazetteer


def plain(docs, names):
    out = []
    for i, text in docs:
        words = [(m.start(), m.end()) for m in gazetteer._WORD.finditer(text or "")]
        found = []
        for a in range(len(words)):
            for b in range(a, len(words)):
                if b > a and text[words[b - 1][1]:words[b][0]] != " ":
                    break
                if text[words[a][0]:words[b][1]] in names and text[words[a][0]].isupper():
                    found.append((words[a][0], words[b][1]))
        for s, e in found:
            if not any((x <= s and e <= y) and (x, y) != (s, e) for x, y in found):
                out.append((i, text[s:e], s, e))
    return sorted(out)


def run(spark, docs, names, **more):
    df = spark.createDataFrame([(i, t, "mine") for i, t in docs], "id int, text string, name string").repartition(3)
    table = spark.createDataFrame([(n, "") for n in names], "name string, text string").repartition(3)
    return sorted(tuple(r) for r in gazetteer.detect_names(df, table, "id", **more).collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["Ada", "Bo", "van", "Beek", "Jean-Luc", "O'Neil", "É", "de", "la", "Cruz", "x", "Ada's"]
    names = {" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(40)}
    gaps = [" ", " ", " ", "  ", ", ", "\n", " 7 "]
    docs = [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    return docs + [(900, None), (901, ""), (902, "Ada " * 20_000)], {n for n in names if n[0].isupper()}


def test_as_plain(spark):
    docs, names = corpus(1)
    got = run(spark, docs[:-1], [*names, *names, None, "", "12", "lower name"])
    assert got == plain(docs[:-1], names)
    assert any(t.count(" ") >= 2 for _, t, _, _ in got)


def test_full_filter_errs_without_effect(spark, monkeypatch):
    # a filter far too small lets much through; the join still decides
    monkeypatch.setattr(gazetteer, "MAX_FILTER_BYTES", 8)
    docs, names = corpus(2)
    assert run(spark, docs, names) == plain(docs[:-1], names) + ([(902, "Ada", 4 * k, 4 * k + 3) for k in range(20_000)] if "Ada" in names else [])


def test_filter_states_its_error(spark):
    names = spark.createDataFrame([(f"N{i} Family{i}",) for i in range(3000)], "name string")
    names = names.selectExpr("translate(name, '0123456789', 'abcdefghij') AS name")
    sieve, stated = gazetteer.build_filter(names, error=0.02)
    assert stated < 0.025
    passed = sum(sieve.holds(f"Other{i}", True) for i in range(20_000)) / 20_000
    assert passed < 2 * stated
    letters = str.maketrans("0123456789", "abcdefghij")
    assert all(sieve.holds(f"N{i} Family{i}".translate(letters), True) for i in range(0, 3000, 100))


def test_nothing(spark):
    assert run(spark, [(1, "Ada Bo")], []) == [] and run(spark, [], ["Ada"]) == []
