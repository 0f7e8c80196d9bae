"""The pipeline, stage by stage, on documents with planted cases."""

import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_minhash import brute

#: Names that stages and operators use for columns of their own.
OWN = ["_row", "_score", "domain", "copies", "row", "told", "score", "_entities", "n_entities", "n_words", "_copy", "col", "t", "k"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        text = words(rng.choice([30, 90, 300]))
        if i % 6 == 0:
            text += " gruntface mudbrain slimeball" * max(2, len(text) // 400)
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, text, rng.choice(["en", "de", None]), f"src{rng.choice([0, 0, 0, 1, 2, 3])}"))
    rows += [(1000 + i, rows[7][1], "en", "src0") for i in range(5)] + [rows[8]] * 2
    rows += [(1010, rows[11][1].replace("w1", "w2", 1), "en", "src1"), (1011, None, "en", "src2"), (1012, "", None, None)]
    rows += [(1013, words(60) + " mail a.person@some.org or +1 (203) 555-8282 now", "en", "src2"), (None, words(50), "en", "src3")]
    return [(*r, len(r[1] or "")) for r in rows], labels


def test_stages(spark, tmp_path):
    rows, labels = planted()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in OWN])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "personal data", "mixing", "encoding"]

    kept = stages["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns
    clean = [tuple(r)[:5] for r in kept.collect()]
    toxic = {i for i, _, y in labels if y}
    assert sorted(map(repr, clean)) == sorted(repr(r) for r in rows if r[0] not in toxic)

    single = stages["near duplicates"](spark, kept, sf)
    got = [tuple(r) for r in single.collect()]
    judged = brute([r[:2] for r in clean if r[0] is not None], 5, 80)
    want = {k for k, n, _, keep in judged if keep} | {None}
    assert single.columns == docs.columns and {r[0] for r in got} == want and len(got) == len(want)

    private = stages["personal data"](spark, single, sf)
    after = {r["doc_id"]: r for r in private.collect()}
    assert private.columns == docs.columns and set(after) == want
    assert "person@some" not in after[1013]["text"] and "555-8282" not in after[1013]["text"]
    assert all(after[r[0]]["text"] == r[1] for r in got if r[0] != 1013)
    assert after[1013]["n_chars"] == len(after[1013]["text"])

    mixed = stages["mixing"](spark, private, sf)
    assert mixed.columns == docs.columns
    supply = private.select(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")))).first()[0]
    taken = mixed.select(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")))).first()[0]
    assert all([r[n] for n in OWN] == [f"mine {n}" for n in OWN] for r in mixed.collect())
    assert abs(taken - 0.9 * supply) < 0.2 * supply and {r["doc_id"] for r in mixed.collect()} <= want

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in mixed.collect()}
    encoded = stages["encoding"](spark, mixed, sf).collect()
    assert len(encoded) == mixed.count()
    for r in encoded:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert bytes(r["ids"]) == data and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(data).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(r["ids_sha256"] for r in whole.collect()) == sorted(r["ids_sha256"] for r in encoded)


def test_near_copies_under_shared_and_missing_ids(spark):
    rng = random.Random(3)
    a, b, c, d, e, f = (" ".join(f"w{rng.randint(0, 900)}" for _ in range(60)) for _ in range(6))
    rows = [
        (5, a), (5, b),  # one id, two texts in groups of their own
        (6, c), (7, c), (7, d), (8, d),  # 7 is a copy of 6, and stands for the group of d
        (None, e), (None, e + " end"), (9, f), (None, f), (None, f), (9, f),
        (10, None), (10, ""), (None, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    alone = [x for x in got if x[0] is None and x[1]]
    assert len(alone) == 1 and alone[0][1] in (e, e + " end")
    want = [(5, a), (5, b), (6, c), (7, d), (9, f), (10, None), (10, ""), (None, ""), (None, None), *alone]
    assert got == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
