"""Batches under a token budget, and chunks by tokens, beside plain loops."""

import random
import re

import pytest

from veilwork.operators import chunks, model, pii, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def padding(batches):
    return sum(max(b) * len(b) - sum(b) for b in batches)


@pytest.fixture(scope="module")
def lengths():
    rng = random.Random(4)
    return [(i, rng.choice([0, 1, 5, 40, 300, 9000, rng.randint(0, 2500)])) for i in range(2000)]


def batches_of(spark, lengths, **more):
    df = spark.createDataFrame([(i, n, "mine", "mine") for i, n in lengths], "id long, words long, batch_id string, fits string")
    got = tokens.token_batches(df.repartition(5), "id", "words", **more)
    assert got.columns == ["id", "words", "fits", "n_tokens", "batch_id", "batch_rows", "batch_longest", "batch_cost"]
    return got.collect()


def test_batches_keep_to_the_budget(spark, lengths):
    rows = batches_of(spark, lengths, rows_per_slot=200)
    assert sorted((r["id"], r["n_tokens"]) for r in rows) == lengths
    batches = {}
    for r in rows:
        batches.setdefault(r["batch_id"], []).append(r)
    for held in batches.values():
        sizes = [r["n_tokens"] for r in held]
        assert {(r["batch_rows"], r["batch_longest"], r["batch_cost"]) for r in held} == {
            (len(held), max(sizes), max(sizes) * len(held))}
        assert len(held) <= 64 and (len(held) == 1 or max(sizes) * len(held) <= 8192)
    # padding no worse than that of batches in key order under the same budget
    in_order, now = [], []
    for _, n in lengths:
        if now and (len(now) == 64 or max([*now, n]) * (len(now) + 1) > 8192):
            in_order.append(now)
            now = []
        now = [*now, n]
    assert padding([[r["n_tokens"] for r in b] for b in batches.values()]) < padding([*in_order, now]) / 5
    assert len(batches) <= len(in_order) + 1


def test_batches_of_odd_rows(spark):
    rows = batches_of(spark, [(1, None), (2, -3), (3, 10**12), (3, 10**12), (4, 0)], budget=10, max_rows=2)
    assert sorted((r["id"], r["n_tokens"], r["batch_rows"]) for r in rows)[2:4] == [(3, 10**12, 1)] * 2
    assert sum(1 / r["batch_rows"] for r in rows) == 4
    assert batches_of(spark, []) == []
    with pytest.raises(ValueError):
        tokens.token_batches(spark.range(1), "id", "id", budget=0)


def test_no_global_sort(spark, lengths):
    df = spark.createDataFrame(lengths, "id long, words long")
    plan = tokens.token_batches(df, "id", "words")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan


def test_budget_inside_a_task():
    rng = random.Random(2)
    lengths = [rng.choice([0, 3, 700, 9000]) for _ in range(500)]
    cut = list(model.budgeted(lengths, 32, 4000))
    assert sorted(i for b in cut for i in b) == list(range(500))
    assert all(len(b) <= 32 and (len(b) == 1 or max(lengths[i] for i in b) * len(b) <= 4000) for b in cut)
    assert list(model.budgeted([], 32, 4000)) == []


TEXTS = [
    "", " \n\t", "one", "  lead and trail \n ", " ".join(f"w{i}" for i in range(50)), "a  b\n\nc\td " * 30,
    "é😀 " * 25 + "ü", "x" * 70_000 + " " + "y " * 40, "\n".join(f"l{i} m" for i in range(3000)), "no blank here",
]


def plain_chunks(text, size, overlap):
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    if not words:
        return [(0, text, 0)]
    step, out, at = size - overlap, [], 0
    starts = [0] + [s for s, _ in words[1:]] + [len(text)]
    while True:
        last = min(at + size, len(words))
        out.append((starts[at], text[starts[at]:starts[last]], last - at))
        if last == len(words):
            return out
        at += step


@pytest.mark.parametrize("size, overlap", [(7, 3), (10, 0), (1, 0), (1024, 128)])
def test_chunks_as_plain(spark, size, overlap):
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate([*TEXTS, None])], "id int, text string, w string")
    got = {}
    for r in tokens.chunk_tokens(df, "text", size, overlap).collect():
        assert r["w"] == "mine"
        got.setdefault(r["id"], {})[r["chunk_no"]] = (r["chunk_start"], r["chunk"], r["n_tokens"])
    assert set(got) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        found = [got[i][k] for k in sorted(got[i])]
        assert sorted(got[i]) == list(range(len(found)))
        assert found == plain_chunks(text, size, overlap)
        assert all(text[s:s + len(c)] == c and n <= size for s, c, n in found)


def test_spans_lifted_from_token_chunks(spark):
    rng = random.Random(8)
    parts = ["John Smith", "a@b.co", "01/15/1990", "word", "other", "(555) 987-6543", "\n", "456 Oak Ave, Boston, MA 02101", "x  y"]
    df = spark.createDataFrame([(i, " ".join(rng.choices(parts, k=200))) for i in range(20)], "id int, text string")
    pieces = tokens.chunk_tokens(df, "text", 40, 12)
    from veilwork.functions import rules

    lifted = chunks.lift_spans(pii.add_entities(pieces, "chunk", "entities"), "id", priority=[r.label for r in rules.PII_RULES])
    spans = lambda es: [(e["start"], e["end"], e["entity_group"]) for e in es]
    whole = {r["id"]: spans(r["entities"]) for r in pii.add_entities(df, "text", "entities").collect()}
    assert {r["id"]: spans(r["entities"]) for r in lifted.collect()} == whole
