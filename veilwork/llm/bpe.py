"""BPE encoding through a mapped lexicon automaton, and decoding.

Frequent words of the corpus are counted over all texts (in sketches of bounded
size), encoded on the driver and compiled into the automaton.  Workers look
pre-tokens up there; what it lacks is merged exactly.  The choice of words
changes the speed alone.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilwork.llm.lexicon import Lexicon, compile_words
from veilwork.llm.merges import (
    BYTE_PATTERN, LONG_TEXT, Merges, PreTokens, newer_letters, split_specials,
)

BUCKETS = 16
#: Characters of the short texts that are taken together.
GROUP = 1 << 18
#: Words whose ids a worker keeps, in each of two halves: speed only.
MEMO = 150_000
_shipped: dict[tuple[str, str], str] = {}


def frequent_words(docs: DataFrame, text: str = "text", per_bucket: int = 1024) -> list[str]:
    """About the ``16 * per_bucket`` most frequent pre-tokens of all texts.

    One sketch per hash bucket of words, merged behind the map side; the answer
    has at most that many words, whatever the table.
    """
    # as the tokenizer's pattern, in this regex dialect; near enough to choose words
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    word = docs.select(
        F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(pattern), F.lit(0))).alias("w")
    )
    top = word.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("b")).agg(
        F.expr(f"approx_top_k(w, {per_bucket}, {2 * per_bucket})").alias("top")
    )
    rows = top.select(F.explode("top").alias("x")).select("x.item", "x.count").where("count > 1")
    return sorted(r["item"] for r in rows.collect())


def ship(spark: SparkSession, data: bytes) -> str:
    """Give every executor a local copy of the file; the name it is found by."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    context = spark.sparkContext
    if (context.applicationId, name) not in _shipped:
        path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
        with open(path, "wb") as file:
            file.write(data)
        context.addFile(path)
        _shipped[context.applicationId, name] = path
    return name


class Encoder:
    def __init__(self, merges: Merges, lexicon: Lexicon, newer: str | None = None):
        self.merges, self.lexicon = merges, lexicon
        self.pre = PreTokens(BYTE_PATTERN, newer)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8") for w in words]
        unseen = []
        for i, number in enumerate(self.lexicon.find(raw).tolist()):
            if number >= 0:
                self.memo[words[i]] = np.array(self.lexicon.output(number), "<u4").tobytes()
            else:
                unseen.append(i)
        merged = self.merges.encode_many([raw[i] for i in unseen])
        self.memo.update((words[i], data) for i, data in zip(unseen, merged))

    def _parts(self, text: str):
        """Lists of pre-tokens, and special ids as bytes."""
        for part, special in split_specials(text, self.merges.specials):
            if part is None:
                yield special.to_bytes(4, "little")
            else:
                yield from self.pre.pieces(part)

    def _known(self, parts: list) -> None:
        """Answers for all words of the parts; what was asked for long ago is forgotten."""
        words = set().union(*(p for p in parts if not isinstance(p, bytes)))
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        new = words.difference(self.memo)
        self.memo.update((t, self.older[t]) for t in new if t in self.older)
        if unknown := [t for t in new if t not in self.memo]:
            self.learn(unknown)

    def _joined(self, parts: list) -> bytes:
        find = self.memo.__getitem__
        return b"".join(p if isinstance(p, bytes) else b"".join(map(find, p)) for p in parts)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a long text goes piece by piece."""
        out = []
        for part in self._parts(text):
            self._known([part])
            out.append(self._joined([part]))
        return b"".join(out)

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Short texts are taken together, so that one walk looks up the new words of all;
        no more than one such group of texts is held."""
        group: list[list] = []
        size = 0

        def close() -> Iterator[bytes]:
            nonlocal group, size
            self._known([p for parts in group for p in parts])
            yield from map(self._joined, group)
            group, size = [], 0

        for text in texts:
            if len(text) > LONG_TEXT:
                yield from close()
                yield self.encode(text)
                continue
            group.append(list(self._parts(text)))
            size += len(text)
            if size > GROUP:
                yield from close()
        yield from close()


class _Shipped:
    """What workers need to encode: made on the driver, small beside a worker's own memory."""

    def __init__(self, docs: DataFrame, path: str, text: str):
        self.merges = Merges(path)
        words = {w.encode("utf-8"): [] for w in frequent_words(docs, text)}
        name = ship(docs.sparkSession, compile_words({w: self.merges.encode(w) for w in words}))
        shared = docs.sparkSession.sparkContext.broadcast(vars(self.merges))
        newer = newer_letters()
        self.encoder = lambda: Encoder(Merges.of(shared.value), Lexicon(SparkFiles.get(name)), newer)


def _texts(batch: pd.Series) -> Iterator[str]:
    return (b.decode("utf-8", "replace") for b in batch)


def encoded(docs: DataFrame, path: str, text: str = "text") -> Column:
    """Column of ids (binary, 4 little-endian bytes each) of every whole text.

    Null counts as empty and gives no ids.  Special strings in a text become
    their ids, as the tokenizer's default has it.  A worker holds one Arrow
    batch, one text's pre-tokens in pieces, and a memo of bounded size.
    """
    encoder_of = _Shipped(docs, path, text).encoder

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of()
        for batch in batches:
            yield pd.Series(list(encoder.encode_many(_texts(batch))), dtype=object)

    return ids(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))


def checked(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> Column:
    """Struct of n_tokens, ids_sha256 and decoded_sha256 (and ids) of every whole text.

    Encodes, decodes the ids and keeps digests of both, in one step: neither ids
    nor decoded texts leave the worker unless ids are asked for.  Texts are
    treated as by ``encoded`` and ids as by ``decoded``.
    """
    encoder_of = _Shipped(docs, path, text).encoder
    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    @F.pandas_udf(kind)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of()
        parts = encoder.merges.bytes
        for batch in batches:
            rows = []
            for data in encoder.encode_many(_texts(batch)):
                numbers = np.frombuffer(data, "<u4").tolist()
                back = b"".join(map(parts.__getitem__, numbers)).decode("utf-8", "replace").encode("utf-8")
                digests = hashlib.sha256(data).hexdigest(), hashlib.sha256(back).hexdigest()
                rows.append((len(numbers), *digests, data) if with_ids else (len(numbers), *digests))
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + with_ids]
            yield pd.DataFrame(rows, columns=names)

    return both(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))


def decoded(spark: SparkSession, ids: Column, path: str) -> Column:
    """Column of texts for a column of ids; unknown ids are left out, null stays null.

    Bytes that are no UTF-8 (ids cut inside a character) become U+FFFD.
    """
    merges = Merges(path)
    size = max(merges.bytes) + 1
    shared = spark.sparkContext.broadcast([merges.bytes.get(i, b"") for i in range(size)])

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts = shared.value
        for batch in batches:
            out = []
            for data in batch:
                if data is None:
                    out.append(None)
                    continue
                numbers = np.frombuffer(data, "<u4")
                known = numbers[numbers < len(parts)].tolist()
                out.append(b"".join(map(parts.__getitem__, known)).decode("utf-8", "replace"))
            yield pd.Series(out, dtype=object)

    return text(ids)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The table with a column ``ids`` (one of that name gives way to it)."""
    return docs.withColumn("ids", encoded(docs, path, text))


def encode_checked(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The table with n_tokens, ids_sha256 and decoded_sha256 (and ids), each row by ``checked``.

    Columns of these names give way; all others stay as they are.
    """
    added = ["ids"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [f"`{c}`" for c in docs.columns if c not in added]
    packed = docs.select(F.struct(*keep).alias("row"), checked(docs, path, text, with_ids).alias("new"))
    return packed.select("row.*", *[f"new.{c}" for c in added])


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    return docs.withColumn(out, decoded(docs.sparkSession, F.col(f"`{ids}`"), path))
