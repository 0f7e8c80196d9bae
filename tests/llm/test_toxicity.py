"""The automaton beside all edits, and scores on rows that were not learnt from."""

import random
import zlib

from veilwork.llm import toxicity


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if a == b:
        return True
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        return len(at) == 1 or (
            len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]])
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def test_automaton():
    rng = random.Random(1)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))): rng.random() for _ in range(40)}
    trie = toxicity.Trie(terms)
    for _ in range(1500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        assert trie.within_one(word) == max([w for t, w in terms.items() if one_edit(t, word)], default=0.0)


def test_prefilter_loses_no_term():
    terms = {"horrid": 5.0, "nasty": 4.0}
    lexicon = toxicity.Lexicon({}, {}, terms)
    for term in terms:
        for i in range(len(term)):
            variants = {term[:i] + term[i + 1:], term[:i] + "q" + term[i:], term[:i] + "q" + term[i + 1:],
                        term[:i] + term[i + 1:i + 2] + term[i] + term[i + 2:]}
            assert all(lexicon.weight(v) == terms[term] for v in variants), (term, i)
    assert lexicon.weight("n4sty") == 4.0 and lexicon.weight("pastries") == 0.0


def make(n, seed):
    rng = random.Random(seed)
    bad = ["gruntface", "mudbrain", "slimeball"]
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 3000)}x" for _ in range(rng.choice([20, 200, 900]))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        elif i % 11 == 0:
            words.insert(3, '"' + bad[0] + '"')
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_scores(spark):
    rows, labels = make(900, 2)
    rows += [(10_000, None), (10_001, ""), (10_002, "you are a gruntfacee mudbrian and a slimebal " * 3), (None, "plain"),
             (0, rows[0][1]), (10_003, "x " * 1_200_000 + "mudbrain slimeball gruntface mudbrain")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, score int").repartition(4)
    marks = spark.createDataFrame([(i, y, 1) for i, y in labels] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    out = toxicity.score_toxicity(docs, marks)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)
    assert len(held) > 100 and right > 0.97, right
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert (by[10_000], by[10_001], by[10_002], by[None]) == (0, 0, 1, 0)


def test_misspellings_of_a_word_that_a_stem_covers(spark):
    forms = ["stupid", "stupid", "stupidly", "stupidest"]
    rows = [(1, f"you {forms[i % 4]} fool{i}") for i in range(40)] + [(0, f"plain words {i}") for i in range(80)]
    words, stems, fuzzy = toxicity.learn_terms(spark.createDataFrame(rows, "y int, t string"))
    assert "stupid" not in words and any("stupid".startswith(s) for s in stems)
    lexicon = toxicity.Lexicon(words, stems, fuzzy)
    for word in ("stpid", "sttupid", "tsupid", "sutpid", "xstupid"):
        assert lexicon.weight(word) >= 0.6 * toxicity.TELLING, word


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score_toxicity(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.score_toxicity(docs.limit(0), none).collect() == []


def plain_features(text, lexicon):
    """Hits with their weight, and whether each is quoted, line by line."""
    out, n = [], 0
    for line in text.lower().split("\n"):
        words = list(toxicity._TOKEN.finditer(line))
        for i, m in enumerate(words):
            w = lexicon.weight(m[0])
            if w:
                marks = "\"“”„«»‹›"
                opened = sum(c in marks for c in line[:m.start()]) % 2
                closed = any(c in marks for c in line[m.end():])
                told = any(x[0] in toxicity._REPORT for x in words[max(0, i - toxicity.REPORTED):i])
                out.append((n + i, w, bool(opened and closed or told)))
        n += len(words)
    return out, n


def test_quoting_as_plain(monkeypatch):
    monkeypatch.setattr(toxicity, "_PIECE", 40)  # pieces of a few words: the cuts must not show
    lexicon = toxicity.Lexicon({"bad": 5.0, "worse": 2.0}, {}, {})
    rng = random.Random(4)
    seen = []
    real = toxicity._quoted

    def kept(text, hits, reports):
        seen.append((hits[:, 0].tolist(), real(text, hits, reports).tolist()))
        return real(text, hits, reports)

    monkeypatch.setattr(toxicity, "_quoted", kept)
    for _ in range(300):
        text = "".join(rng.choice(["bad ", "worse", " ", "İx ", '"', "«", "\n", "said ", "a b c ", "word "]) for _ in range(rng.randint(1, 60)))
        seen.clear()
        got = toxicity.features(text, lexicon)
        hits, n = plain_features(text, lexicon)
        assert got[5] == toxicity.math.log1p(n)
        assert seen == ([([i for i, _, _ in hits], [q for _, _, q in hits])] if hits else [])
        best = max((sum(w for j, w, q in hits if not q and i - toxicity.WINDOW < j <= i) for i, _, _ in hits), default=0)
        assert abs(got[0] - toxicity.math.log1p(best)) < 1e-9


def test_no_limit_of_length():
    lexicon = toxicity.Lexicon({"mudbrain": 5.0}, {"stupid": 5.0}, {})
    assert lexicon.weight("stupid" + "x" * 94) == 5.0 and lexicon.weight("stupid" + "x" * 3_000_000) == 5.0
    assert lexicon.weight("5tup1d" + "x" * 94) == 5.0
    quoted = toxicity.features('"' + "plain things " * 250_000 + "mudbrain" + " and more" * 100_000 + '"', lexicon)
    assert quoted[1] == 0.0 and quoted[4] > 1
    apart = toxicity.features('"' + "plain things " * 250_000 + "mudbrain" + " and more" * 100_000 + "\n", lexicon)
    assert apart[1] > 1 and apart[4] == 0.0
