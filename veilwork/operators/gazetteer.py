"""Names by a large table: a Bloom filter over the trie of their words in front of an exact join."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from veilwork.operators.rows import quoted
from veilwork.operators.skew import lookup_join
from veilwork.session import run_dir

# What runs in the workers travels with the job: they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: Bytes of the filter at most; with more names than fit, it errs more often, never the result.
MAX_FILTER_BYTES = 32 << 20
_CHUNK = 1 << 16


def _places(phrase: str, is_name: bool, bits: int, hashes: int) -> list[int]:
    """Bits of a node of the trie (the first words of names), or of a whole name."""
    digest = blake2b(phrase.encode(), digest_size=16, person=b"name" if is_name else b"node").digest()
    a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
    return [(a + i * b) % bits for i in range(hashes)]


def split_name(name: str) -> list[str]:
    return _WORD.findall(name)


class NameFilter:
    """Which phrases may be a name, or may go on to be one."""

    def __init__(self, bits: int, hashes: int, data: np.ndarray):
        self.bits, self.hashes, self.data = bits, hashes, data

    def holds(self, phrase: str, is_name: bool) -> bool:
        data = self.data
        return all(data[p >> 3] >> (p & 7) & 1 for p in _places(phrase, is_name, self.bits, self.hashes))

    def candidates(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(phrase, start, end) of words in a row, one blank apart, that may be a name."""
        words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]
        for i, (phrase, start, end) in enumerate(words):
            if not phrase[0].isupper():
                continue
            j = i
            while self.holds(phrase, False):
                if self.holds(phrase, True):
                    yield phrase, start, end
                j += 1
                if j == len(words) or words[j][1] != end + 1 or text[end] != " ":
                    break
                phrase, end = f"{phrase} {words[j][0]}", words[j][2]


def build_filter(names: DataFrame, name_col: str = "name", error: float = 0.01) -> tuple[NameFilter, float]:
    """The filter over all names, and the share of foreign phrases that pass it.

    Each task sets bits in pieces of 64 KiB, and equal pieces are joined by OR;
    the driver gets no more than the filter, whose size is bounded.
    """
    words = F.size(F.split(F.col(quoted([name_col])[0]), " ")).cast("long")
    n = max(1, 2 * (names.agg(F.sum(words)).first()[0] or 0))  # nodes and ends at most
    wanted = math.ceil(-n * math.log(error) / math.log(2) ** 2)
    bits = max(64, min(wanted, 8 * MAX_FILTER_BYTES))
    hashes = max(1, round(bits / n * math.log(2)))
    stated = (1 - math.exp(-hashes * n / bits)) ** hashes

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            for name in batch.column(0).to_pylist():
                parts = split_name(name or "")
                for k in range(1, len(parts) + 1):
                    phrase = " ".join(parts[:k])
                    for p in _places(phrase, False, bits, hashes) + (_places(phrase, True, bits, hashes) if k == len(parts) else []):
                        piece = pieces.setdefault(p >> 3 >> 16, np.zeros(_CHUNK, np.uint8))
                        piece[p >> 3 & _CHUNK - 1] |= 1 << (p & 7)
        yield pa.record_batch({
            "piece": pa.array(list(pieces), pa.int64()), "data": pa.array([x.tobytes() for x in pieces.values()], pa.binary()),
        })

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros(_CHUNK, np.uint8)
        for x in rows["data"]:
            data |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "data": [data.tobytes()]})

    kind = "piece bigint, data binary"
    made = names.select(F.col(quoted([name_col])[0]).cast("string")).mapInArrow(set_bits, kind)
    pieces = made.groupBy("piece").applyInPandas(joined, kind).collect()
    data = np.zeros(-(-bits // 8 // _CHUNK + 1) * _CHUNK + _CHUNK, np.uint8)
    for piece, content in pieces:
        data[piece * _CHUNK:(piece + 1) * _CHUNK] = np.frombuffer(content, np.uint8)
    return NameFilter(bits, hashes, data), stated


def detect_names(
    df: DataFrame, names: DataFrame, key: str, text_col: str = "text", name_col: str = "name", error: float = 0.01
) -> DataFrame:
    """One row per name of the table that a text holds: key, text, start and end.

    Names may have several words (joined by single blanks) and begin with a
    capital; their other words need not.  Texts pass a filter over the trie of
    the names' words, so only phrases that are names, and a stated share of
    others, are shuffled for the exact join, in which the name's own spelling
    decides.  A name inside a longer one found at that place is left out.
    NULL texts hold none; a name without a word is in no text.  The key tells
    texts apart.
    """
    spark = df.sparkSession
    found, _ = build_filter(names, name_col, error)
    shared = spark.sparkContext.broadcast((found.bits, found.hashes, found.data))
    (k,), (t,) = quoted([key]), quoted([text_col])
    added = T.StructType.fromDDL("name string, start int, `end` int")
    kind = T.StructType([*df.select(F.col(k).alias("key")).schema.fields, *added.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = NameFilter(*shared.value)
        for batch in batches:
            rows, phrases, starts, ends = [], [], [], []
            for i in range(batch.num_rows):
                for phrase, start, end in sieve.candidates(batch.column(1)[i].as_py() or ""):
                    rows.append(i)
                    phrases.append(phrase)
                    starts.append(start)
                    ends.append(end)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(phrases, pa.string()),
                 pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "name", "start", "end"])

    path = run_dir(spark, "names")
    df.select(F.col(k).alias("key"), F.col(t).cast("string").alias("text")).mapInArrow(scan, kind).write.parquet(path)
    known = names.select(F.col(quoted([name_col])[0]).cast("string").alias("name")).distinct()
    met = lookup_join(spark.read.parquet(path), known, "name", "start")
    # of matches that begin earlier, or as early and end later, none may reach as far
    earlier = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    whole = met.withColumn("reach", F.max("end").over(earlier)).where("reach IS NULL OR end > reach")
    return whole.select(F.col("key").alias(key), F.col("name").alias("text"), "start", "end")
