"""Encoding, decoding and counting beside the tokenizers library."""

import hashlib
import os
import random
import tempfile

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilwork.llm import bpe, lexicon, token_counts
from veilwork.llm.merges import Merges, LONG_WORD

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n  a", "a" * 5000, "ab" * 3000, "  x  ", "<|endoftext|>a<|endoftext|><|startoftext|>",
    "it's WE'LL 'S don't", "Ünïcödé ß Σας ΣΑΣ İstanbul ǅ", "é é", "日本語 текст 😀👍🏽", "a՘b՘!", "\x00\x1f\x85  x",
    "12345 ½ ² 1a2", "\U0001e030 \U00011f00 Ᲊ Ɤ", "x\r\n\t y", "…”—!!!", "ΑΣ ΑΣ.", "ﬁ ﬀ Ⅷ", "ก็ กำ", "각 각",
]


def _fuzz(n, seed=5):
    rng = random.Random(seed)
    alphabet = "aàeÉst'nlv  \n09.,!<|>Σσßİ日☃́ 　٣"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    plain = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return ODD + _fuzz(1500) + plain + ["".join(plain)]


def _table(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)


def test_encode_and_decode(spark, texts):
    library = Tokenizer.from_file(BYTE)
    df = bpe.decode(bpe.encode(_table(spark, texts), BYTE), BYTE)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in df.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i][0], "<u4").tolist() == ids, repr(text)[:200]
        assert got[i][1] == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("with_ids", [False, True])
def test_both_ways_in_one_step(spark, texts, with_ids):
    library = Tokenizer.from_file(BYTE)
    got = bpe.encode_checked(_table(spark, texts).withColumn("new", F.lit(7)), BYTE, with_ids=with_ids)
    digests = {"n_tokens", "ids_sha256", "decoded_sha256"}
    assert set(got.columns) == {"doc_id", "text", "ids", "new"} | digests
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert rows[i]["ids"] == (packed if with_ids else "clash")
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["new"] == 7 and rows[i]["text"] == text
        assert rows[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        back = library.decode(ids, skip_special_tokens=False).encode()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(back).hexdigest()


def test_side_by_side_as_one_by_one():
    rng = random.Random(3)
    words = [bytes(rng.choices(b" aeinrst\xc3\xa9\xf0", k=rng.randint(0, 60))) for _ in range(4000)]
    words += [b"a" * k for k in range(50)] + [b" the", b"the", b""]
    for path in (BYTE, WORD):
        merges = Merges(path)
        one = [np.array(merges.encode(w), "<u4").tobytes() for w in words]
        assert merges.encode_many(words) == one
        assert merges.encode_many([]) == []


def test_small_memo(monkeypatch):
    library = Tokenizer.from_file(BYTE)
    merges = Merges(BYTE)
    monkeypatch.setattr(bpe, "MEMO", 5)
    monkeypatch.setattr(bpe, "GROUP", 50)
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "words")
        with open(path, "wb") as file:
            file.write(lexicon.compile_words({w: merges.encode(w) for w in (b" the", b"a", b" of")}))
        encoder = bpe.Encoder(merges, lexicon.Lexicon(path))
        texts = [" the cat of a cat " * (i % 4) + f"w{i % 7}" for i in range(60)]
        got = [np.frombuffer(d, "<u4").tolist() for d in encoder.encode_many(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_decode_cut_and_unknown_ids(spark):
    library = Tokenizer.from_file(BYTE)
    ids = library.encode("日本 😀", add_special_tokens=False).ids
    rows = [(np.array(ids[:k] + [999_999], "<u4").tobytes(),) for k in range(len(ids))] + [(None,)]
    got = [r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "ids binary"), BYTE).collect()]
    assert got == [library.decode(ids[:k], skip_special_tokens=False) for k in range(len(ids))] + [None]


def test_counts(spark, texts):
    library = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"])
           for r in token_counts.count_tokens(_table(spark, texts), WORD).collect()}
    for i, text in enumerate(texts):
        expected = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), expected), repr(text)[:200]


def test_empty_tables(spark):
    none = _table(spark, []) if False else spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, BYTE), BYTE).collect() == []
    assert token_counts.count_tokens(none, WORD).collect() == []


def test_whole_tokens_are_proven():
    merges = Merges(WORD)
    whole = token_counts.whole_tokens(merges)
    library = Tokenizer.from_file(WORD)
    assert len(whole) > 20_000
    for word in sorted(whole)[::500]:
        if library.pre_tokenizer.pre_tokenize_str(word)[0][0] and word == word.lower() and word.isalpha():
            assert len(library.encode(word, add_special_tokens=False).ids) == 1


def test_long_words_merge_alike():
    merges = Merges(BYTE)
    rng = random.Random(3)
    for _ in range(50):
        word = bytes(rng.choice(b"abcdetsh ") for _ in range(rng.randint(2, LONG_WORD)))
        assert merges._long(merges.symbols(word)) == merges.encode(word)


def test_automaton_is_minimal_and_exact():
    rng = random.Random(4)
    entries = {bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 7))) + rng.choice([b"ing", b"ed"]):
               [rng.randint(0, 9) for _ in range(rng.randint(1, 3))] for _ in range(120)}
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "x.bin")
        with open(path, "wb") as file:
            file.write(lexicon.compile_words(entries))
        found = lexicon.Lexicon(path)
        asked = [*entries, b"", b"zz", b"ab", b"aing" + b"x" * 50]
        numbers = found.find(asked).tolist()
        for word, number in zip(asked, numbers):
            assert (number >= 0) == (word in entries)
            if number >= 0:
                assert found.output(number) == entries[word]
        # one state per set of endings
        endings = {frozenset(w[i:] for w in entries if w[:i] == p) for x in entries
                   for i in range(len(x) + 1) for p in [x[:i]]}
        assert len(found.final) == len(endings)
