import random

import pytest
import regex
from pyspark.sql import functions as F

from checks import probes
from veilwork import functions as vf, schemas
from veilwork.functions import rules, spans
from veilwork.operators import chunks, persons, pii

DDL = f"id int, text string, entities {schemas.ENTITIES}"


def entity(start, end, label="X", score=0.9, word="", group=True):
    return (label, None, score, word, start, end) if group else (None, label, score, word, start, end)


def masked(spark, rows):
    df = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(rows)], DDL)
    got = df.select("id", vf.apply_mask("text", "entities").alias("m")).collect()
    return [r["m"] for r in sorted(got)]


def detected(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", "text", vf.detect_entities("text").alias("e")).collect()
    return {r["id"]: [(x["entity_group"], x["start"], x["end"], x["word"]) for x in r["e"]] for r in rows}


def model_mask(text, ents):
    """What a mask has to do, in plain Python."""
    for e in sorted(ents, key=lambda e: -e[4]):
        text = text[: e[4]] + f"[{(e[0] or e[1]).upper()}]" + text[e[5] :]
    return text


def test_contract_cases(spark):
    rows = [
        ("abcdefghij", [entity(0, 9, "A"), entity(5, 7, "B")]),
        ("xy", [entity(0, 1, "P"), entity(0, 2, "Q")]),
        ("😀 John at a@b.co", [entity(2, 6, "NAME"), entity(10, 16, "EMAIL", 0.4)]),
        ("plain", []),
        ("plain", None),
        (None, [entity(0, 1)]),
    ]
    want = ["[A]ij", "[Q]]y", "😀 [NAME] at [EMAIL]", "plain", "plain", None]
    assert masked(spark, rows) == want


def test_missing_fields(spark):
    none = (None, None, 0.9, "w", 0, 2)
    rows = [
        ("abcdef", [(None, None, 0.9, "w", 0, 2)]),  # no label: not masked
        ("abcdef", [("", "", 0.9, "w", 0, 2)]),
        ("abcdef", [("A", None, 0.9, "w", 2, None)]),  # no end: to the end of the text
        ("abcdef", [("A", None, 0.9, "w", None, 2)]),  # no start: from the beginning
        ("abcdef", [("", "B", 0.9, "w", 1, 2)]),  # an empty group is a group
        ("abcdef", [(None, "b-loc", 0.9, "w", 1, 2), (None, "I-loc", 0.9, "w", 4, 5)]),
        ("abcdef", [("SUB-ID", None, 0.9, "w", 1, 2)]),
    ]
    assert masked(spark, rows) == [
        "abcdef", "abcdef", "ab[A]", "[A]cdef", "a[]cdef", "a[B-LOC]cd[LOC]f", "a[SUB-ID]cdef",
    ]
    df = spark.createDataFrame([(1, "abcdef", [none, ("A", None, 0.5, None, None, None), (None, "I-A", 0.51, None, None, None)])], DDL)
    got = df.select(vf.extract_entities("entities").alias("l")).first()["l"]
    assert [tuple(x) for x in got] == [("UNKNOWN", "w", 0, 2, 0.9), ("A", "", 0, 0, 0.51)]


def test_offsets_below_zero_and_beyond_the_end(spark):
    rows = [
        ("abcdef", [entity(-2, 6, "A")]),
        ("abcdef", [entity(1, -2, "A")]),
        ("abcdef", [entity(-20, 2, "A")]),
        ("abcdef", [entity(4, 99, "A")]),
        ("abcdef", [entity(9, 99, "A")]),
        ("abcdef", [entity(3, 1, "A")]),
    ]
    assert masked(spark, rows) == [model_mask(t, e) for t, e in rows]


def test_random_spans_like_the_model(spark):
    rng = random.Random(7)
    alphabet = "ab😀é漢 "
    rows = []
    for i in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        ents = []
        if i % 2:  # anything: overlaps, ties, empty spans
            for _ in range(rng.randint(0, 5)):
                a = rng.randint(0, len(text) + 1)
                ents.append(entity(a, rng.randint(a, len(text) + 2), rng.choice("PQR")))
        else:  # disjoint, in random order
            cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 4)) // 2 * 2))
            ents = [entity(a, b, rng.choice("PQR")) for a, b in zip(cuts[::2], cuts[1::2])]
            rng.shuffle(ents)
        rows.append((text, ents))
    assert masked(spark, rows) == [model_mask(t, e) for t, e in rows]


def test_many_spans_like_the_model(spark):
    """Beyond the number up to which cuts walk the text."""
    rng = random.Random(8)
    rows = []
    for n in (1, 63, 64, 65, 1000):
        text = "".join(rng.choice("ab😀é漢 ") for _ in range(5 * n))
        cuts = sorted(rng.sample(range(len(text) + 1), 2 * n))
        ents = [entity(a, b, rng.choice("PQR")) for a, b in zip(cuts[::2], cuts[1::2])]
        rng.shuffle(ents)
        rows += [(text, ents), (text, [*ents, entity(0, 3 * n, "S")])]
    assert masked(spark, rows) == [model_mask(t, e) for t, e in rows]


def test_merge_bio(spark):
    text = "John Smith Al 7 wait a@b.c"
    tags = [("B-NAME", 0, 4, 0.9), ("I-NAME", 5, 10, 0.7), ("B-NAME", 11, 13, 0.6), ("I-EMAIL", 21, 26, 0.8)]
    ents = [entity(a, b, t, s, group=False) for t, a, b, s in tags]
    random.Random(1).shuffle(ents)
    df = spark.createDataFrame([(1, text, ents)], DDL)
    got = df.select(vf.merge_bio("text", "entities").alias("m")).first()["m"]
    assert [(x["entity_group"], x["word"], round(x["score"], 9)) for x in got] == [
        ("NAME", "John Smith", 0.8), ("NAME", "Al", 0.6), ("EMAIL", "a@b.c", 0.8),
    ]
    far = [entity(0, 4, "B-NAME"), entity(9, 12, "I-NAME")]
    got = spark.createDataFrame([(1, text, far)], DDL).select(vf.merge_bio("text", "entities").alias("m")).first()["m"]
    assert [(x["start"], x["end"]) for x in got] == [(0, 4), (9, 12)]


def test_pii_cases(spark):
    found = detected(spark, [t for t, _ in probes.PII_CASES])
    for i, (text, expected) in enumerate(probes.PII_CASES):
        assert found[i], text
        assert {label for label, *_ in found[i]} & set(expected), text


def test_edge_texts_are_left_alone(spark):
    texts = [*probes.EDGE_TEXTS, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select(
        "id", "text", vf.mask_pii_text("text").alias("m"), F.size(vf.detect_entities("text")).alias("n"),
        vf.score_injection("text").alias("s"), vf.check_prompt_injection("text").alias("c"),
    ).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["m"], r["n"], r["s"], r["c"]) == (r["text"], 0, 0.0, False)


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    words = [w for t, _ in probes.PII_PROBES for w in t.split(" ")] + ["é", "ñ", "_", "9", "-", "😀", "\n", "@", "."]
    return [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_rules_find_what_their_patterns_say(spark):
    """The shortcuts (needs, first characters, joint scan) lose nothing."""
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.selectExpr("id", "text", f"{spans.raw_spans('text')} AS s").collect()
    for r in rows:
        want = sorted(
            (m.start(), i + 1, m.end())
            for i, rule in enumerate(rules.PII_RULES)
            for m in regex.finditer(rule.pattern.replace(r"\w", "[0-9A-Za-z_]"), r["text"])
            if m.group()
        )
        assert sorted((x["start"], x["prio"], x["end"]) for x in r["s"]) == want, r["text"]


def test_detected_spans_are_sound(spark):
    texts = corpus(seed=4)
    for i, found in detected(spark, texts).items():
        at = 0
        for _, start, end, word in found:
            assert at <= start < end and texts[i][start:end] == word
            at = end


def test_overlaps_are_joined_like_brute_force(spark):
    rng = random.Random(5)
    text = "0123456789" * 3
    cases = []
    for i in range(200):
        got = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 28)
            got.append((a, rng.randint(1, 4), rng.randint(a + 1, 30)))
        cases.append((i, text, [(a, p, b, f"L{p}", p / 10, "") for a, p, b in got]))
    df = spark.createDataFrame(cases, f"id int, text string, s {schemas.SPANS}")
    for r in df.select("id", vf.resolve_spans("text", "s").alias("r")).collect():
        groups = []
        for a, p, b, *_ in sorted(cases[r["id"]][2]):
            if groups and a < groups[-1][1]:
                groups[-1] = (groups[-1][0], max(groups[-1][1], b), min(groups[-1][2], p))
            else:
                groups.append((a, b, p))
        got = [(x["start"], x["end"], x["prio"]) for x in r["r"]]
        assert got == groups
        assert all(x["label"] == f"L{x['prio']}" for x in r["r"])


def test_nothing_is_left_in_masked_text(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in probes.PII_PROBES)), "id int, text string")
    again = pii.mask_pii(pii.mask_pii(df, return_entities=False).select(F.col("masked_text").alias("text")))
    assert again.where(F.size("entities") > 0).count() == 0


def test_marks_in_the_text_do_no_harm(spark):
    text = f"x{spans.MARK} a@b.co {spans.MARK}{spans.SPARE} 555-1234"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert df.select(vf.mask_pii_text("text").alias("m")).first()["m"] == (
        f"x{spans.MARK} [EMAIL] {spans.MARK}{spans.SPARE} [PHONE_NUMBER]"
    )


def test_long_texts(spark):
    """Many entities in one text, and a long run that only looks like one."""
    many = " ".join(f"u{i}@example.com" for i in range(3000))
    run = "a" * 300_000 + " x@y.zz"
    df = spark.createDataFrame([(1, many), (2, run)], "id int, text string")
    rows = {r["id"]: r["m"] for r in df.select("id", vf.mask_pii_text("text").alias("m")).collect()}
    assert rows[1] == " ".join(["[EMAIL]"] * 3000)
    assert rows[2] == "a" * 300_000 + " [EMAIL]"


def test_return_entities_switch(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "id int, text string")
    assert pii.mask_pii(df, return_entities=False).columns == ["id", "text", "masked_text"]
    assert pii.mask_pii(df).columns == ["id", "text", "masked_text", "entities"]


def test_status_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, "a@b.co 555-1234 a@b.co"), (2, ""), (3, None)], "id int, text string")
    rows = {r["id"]: r for r in pii.pii_status(pii.mask_pii(df)).collect()}
    assert [rows[i]["pii_status"] for i in (1, 2, 3)] == ["masked", "clean", "clean"]
    assert rows[1]["types"] == ["EMAIL", "PHONE_NUMBER"]


def test_persons_by_table(spark):
    texts = ["Dear John Smith", "John said", "John John Doe", "xJohn Doe", "Émile Zola, John Éluard"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    names = spark.createDataFrame([("John",), ("Émile",), ("John",)], "name string")
    got = sorted((r["id"], r["text"], r["start"], r["end"]) for r in persons.detect_persons(df, names, "id").collect())
    assert got == [
        (0, "John Smith", 5, 15), (2, "John Doe", 5, 13), (2, "John John", 0, 9),
        (4, "John Éluard", 12, 23), (4, "Émile Zola", 0, 10),
    ]
    for _, text, start, end in got:
        assert any(t[start:end] == text for t in texts)


def test_chunks_cover_the_text(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab😀é") for _ in range(n)) for n in (0, 1, 9, 10, 11, 16, 17, 95, 390, 700)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = chunks.chunk_text(df, max_chars=10, overlap=4).collect()
    for i, text in enumerate(texts):
        mine = sorted((r["chunk_no"], r["chunk_start"], r["chunk"]) for r in rows if r["id"] == i)
        if text is None:
            assert mine == []
            continue
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert all(text[s : s + 10] == c for _, s, c in mine)
        assert mine[-1][1] + 10 >= len(text) and all(len(c) == 10 for _, _, c in mine[:-1])
    with pytest.raises(ValueError):
        chunks.chunk_text(df, max_chars=5, overlap=5)


def test_lifted_spans_are_joined(spark):
    """A span cut by a piece's end is one span again, with its whole word."""
    text = "..long-name@example.com.."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    pieces = chunks.chunk_text(df, max_chars=16, overlap=8)
    found = pieces.withColumn(
        "entities",
        F.expr(
            "transform(filter(array(1), x -> chunk_start <= 8), x -> named_struct('entity_group', 'E', "
            "'entity', CAST(NULL AS string), 'score', 0.9D, "
            "'word', substring(chunk, greatest(2 - chunk_start, 0) + 1), "
            "'start', greatest(2 - chunk_start, 0), 'end', length(chunk)))"
        ),
    )
    got = chunks.lift_spans(found, "id").first()["entities"]
    assert [(x["start"], x["end"], x["word"]) for x in got] == [(2, 24, text[2:24])]


def test_no_span_is_made_by_a_cut(spark):
    """Digits at every place around every cut: masked in pieces as in the whole text."""
    rows = []
    for n, digits in ((16, "4"), (21, "7"), (17, "1")):
        rows += [" ".join(["word"] * 3) + " " * gap + digits * n + " and more text behind it " * 4 for gap in range(1, 70)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    whole = {r["id"]: r["masked_text"] for r in pii.mask_pii(df).collect()}
    cut = chunks.mask_in_chunks(df, lambda d: d.withColumn("entities", vf.detect_entities("chunk")), "id", max_chars=80, overlap=40)
    assert {r["id"]: r["masked_text"] for r in cut.collect()} == whole


def test_spans_longer_than_the_overlap_are_masked(spark):
    """Cut in every piece, at every place around every cut."""
    rows = [(gap, size, "-" * gap + "Q" * size + "-" * 60) for size in (7, 8, 9, 15, 50) for gap in range(0, 40, 3)]
    df = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)], "id int, text string")
    finder = lambda d: d.withColumn("entities", F.expr(
        "transform(filter(array(locate('Q', chunk)), p -> p > 0), p -> named_struct('entity_group', 'E', "
        "'entity', CAST(NULL AS string), 'score', 0.9D, 'word', regexp_extract(chunk, 'Q+', 0), "
        "'start', p - 1, 'end', p - 1 + length(regexp_extract(chunk, 'Q+', 0))))"
    ))
    out = chunks.mask_in_chunks(df, finder, "id", max_chars=20, overlap=8).collect()
    assert len(out) == len(rows)
    for r in out:
        gap, size, text = rows[r["id"]]
        assert "Q" not in r["masked_text"] and [(e["start"], e["end"]) for e in r["entities"]] == [(gap, gap + size)], r
