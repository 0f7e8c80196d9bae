"""How sources of a language differ in their words: a vocabulary automaton recounts the texts.

The terms that enough documents of a language hold are sorted, and compiled, in
blocks of about a megabyte, into minimal acyclic transducers that map a term to
its ordinal in the language.  The texts stream through them a second time; what
is shuffled from there on are ordinals with counts, and ties are broken by
ordinals, as they order terms by their UTF-8 bytes.

Both passes over the texts count inside the task first.  The transducers are
broadcast in packs of bounded size, one pass over the texts of their languages
for each pack, so the broadcast does not grow with the vocabulary.  Sources are
compared in tiles: a task holds the shares of some thousand terms in up to two
tiles of sources.
"""

from __future__ import annotations

import string
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.llm.common import cut, join_small
from veilwork.llm.lexicon import Lexicon, compile_words

#: Documents of a language that must hold a term.
LEAST_DOCS = 30
#: Added to every count, and the scale of shares.
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
#: Bytes of the terms of one transducer, and of the transducers of one broadcast.
BLOCK_BYTES = 1 << 20
PACK_BYTES = 32 << 20
#: Entries that a task counts before it hands them on.
HELD = 500_000
#: Terms and sources that are compared at once.
TERMS = 4096
TILE = 256

# terms are runs of ASCII letters and of bytes beyond ASCII; all else parts them
_LETTERS = string.ascii_letters.encode()
_FOLD = bytes(
    32 if b < 128 and b not in _LETTERS else b | 32 if 65 <= b <= 90 else b for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, with repeats; A-Z come out as a-z."""
    return text.translate(_FOLD).split() if text else []


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(lang, source, text) row by row: one text at a time is a Python object."""
    lang, source, text = batch.columns
    for i, (a, b) in enumerate(zip(lang.to_pylist(), source.to_pylist())):
        yield a, b, text[i].as_py()


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.record_batch({
                "lang": pa.array([lang] * len(counts), pa.string()),
                "term": pa.array(list(counts), pa.binary()),
                "n": pa.array(list(counts.values()), pa.int64()),
            })
        held.clear()

    for batch in batches:
        for lang, _, text in _rows(batch):
            counts = held[lang]
            size -= len(counts)
            counts.update(set(terms_of(text)))
            size += len(counts)
            if size > HELD:
                yield from handed()
                size = 0
    yield from handed()


def vocabulary(rows: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, ordinal, base, block) of the kept terms; a block holds neighbours in order.

    Ranges of the sorted terms are numbered apart, and the numbers of the ranges
    before are added; no task holds a whole language.
    """
    counted = rows.mapInArrow(_count_documents, "lang string, term binary, n bigint")
    kept = counted.groupBy("lang", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"))
    kept = kept.where(F.col("n") >= least_docs).select("lang", "term")
    ranged = cut(
        kept.repartitionByRange("lang", "term").withColumn("part", F.spark_partition_id()), "audit-terms"
    )
    here = Window.partitionBy("lang", "part").orderBy("term")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("lang", "part").agg(F.count("*").alias("n"))
    sizes = sizes.select("lang", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    size = F.octet_length("term") + 8
    numbered = ranged.select(
        "lang", "part", "term", (F.row_number().over(here) - 1).alias("at"),
        F.expr(f"CAST({BLOCK_BYTES} AS bigint)").alias("limit"),
        F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"),
    )
    placed = numbered.join(F.broadcast(sizes), ["lang", "part"])  # a row for each range and language
    return cut(
        placed.select(
            "lang", "term", (F.col("offset") + F.col("at")).alias("ordinal"), "part",
            F.expr("bytes div limit").alias("block"),
        ),
        "audit-vocabulary",
    )


def _compiled(block: pd.DataFrame) -> pd.DataFrame:
    words = {t.encode(): [] for t in block["term"]}
    first = min(words)
    return pd.DataFrame({
        "lang": [block["lang"].iloc[0]], "first": [first], "base": [int(block["ordinal"].min())],
        "data": [compile_words(words)],
    })


def transducers(kept: DataFrame) -> DataFrame:
    """(lang, first, base, data): a transducer for each block, with its first term and ordinal."""
    return cut(
        kept.groupBy("lang", "part", "block").applyInPandas(
            _compiled, "lang string, first binary, base bigint, data binary"
        ),
        "audit-transducers",
    )


class Ordinals:
    """Ordinals of the terms of one language, from its transducers."""

    def __init__(self, parts: list[tuple[bytes, int, bytes]]):
        parts = sorted(parts)
        self.first = [first for first, _, _ in parts]
        self.parts = [(base, Lexicon(data)) for _, base, data in parts]

    def find(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, or -1."""
        if len(self.parts) == 1:
            base, lexicon = self.parts[0]
            number = lexicon.find(words)
            return np.where(number >= 0, number + base, -1)
        found = np.full(len(words), -1, np.int64)
        place = np.fromiter((bisect_right(self.first, w) - 1 for w in words), np.int64, len(words))
        for i in np.unique(place[place >= 0]).tolist():
            at = np.flatnonzero(place == i)
            base, lexicon = self.parts[i]
            number = lexicon.find([words[j] for j in at.tolist()])
            found[at] = np.where(number >= 0, number + base, -1)
        return found


def _packs(built: DataFrame) -> list[tuple]:
    """Ranges of (lang, base), first and last, that together are at most ``PACK_BYTES``, or one block."""
    sizes = built.select("lang", "base", F.octet_length("data").alias("size")).collect()  # a row a block
    packs: list[list] = []
    held = 0
    for lang, base, size in sorted(tuple(r) for r in sizes):
        if not packs or held + size > PACK_BYTES:
            packs.append([(lang, base), (lang, base), set()])
            held = 0
        held += size
        packs[-1][1] = (lang, base)
        packs[-1][2].add(lang)
    return [tuple(p) for p in packs]


def recounted(rows: DataFrame, built: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n) of the kept terms in all texts."""
    spark = rows.sparkSession
    counts = spark.createDataFrame([], "lang string, source string, ordinal bigint, n bigint")
    packs = _packs(built)
    for first, last, langs in packs:
        place = F.struct("lang", "base")
        mark = lambda x: F.struct(F.lit(x[0]).alias("lang"), F.lit(x[1]).cast("long").alias("base"))
        pack = built.where((place >= mark(first)) & (place <= mark(last))).select("lang", "first", "base", "data")
        shared = spark.sparkContext.broadcast([(r[0], bytes(r[1]), r[2], bytes(r[3])) for r in pack.collect()])
        read = rows.where(F.col("lang").isin(sorted(langs))) if len(packs) > 1 else rows

        def stream(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            parts: dict[str, list] = defaultdict(list)
            for lang, *part in shared.value:
                parts[lang].append(tuple(part))
            known = {lang: Ordinals(p) for lang, p in parts.items()}
            held: dict[tuple, Counter] = defaultdict(Counter)
            size = 0

            def handed() -> Iterator[pa.RecordBatch]:
                for (lang, source), counts in held.items():
                    words = list(counts)
                    ordinal = known[lang].find(words)
                    n = np.fromiter(counts.values(), np.int64, len(words))
                    hit = ordinal >= 0
                    yield pa.record_batch({
                        "lang": pa.array([lang] * int(hit.sum()), pa.string()),
                        "source": pa.array([source] * int(hit.sum()), pa.string()),
                        "ordinal": pa.array(ordinal[hit], pa.int64()),
                        "n": pa.array(n[hit], pa.int64()),
                    })
                held.clear()

            for batch in batches:
                for lang, source, text in _rows(batch):
                    if lang not in known:
                        continue
                    words = held[lang, source]
                    size -= len(words)
                    words.update(terms_of(text))
                    size += len(words)
                    if size > HELD:
                        yield from handed()
                        size = 0
            yield from handed()

        found = read.mapInArrow(stream, counts.schema)
        found = found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
        counts = counts.unionByName(cut(found, "audit-counts"))
        shared.destroy()
    return counts


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * V)), exact for any long."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(n + PRIOR)
    return F.lit(1).cast("long") + F.call_function("div", top, wide(total + PRIOR * F.col("v"))).cast("long")


def _compared(block: pd.DataFrame) -> pd.DataFrame:
    """Summed differences of the sources of two tiles over some thousand terms."""
    start = int(block["start"].iloc[0])
    width = max(0, min(TERMS, int(block["v"].iloc[0]) - start))
    # every source has a row of its own with the share of a term it lacks
    own = block[block["ordinal"] < 0].sort_values("no")
    no = own["no"].to_numpy()
    share = np.repeat(own["p"].to_numpy(np.int64)[:, None], width, axis=1)
    seen = block[block["ordinal"] >= 0]
    share[np.searchsorted(no, seen["no"]), seen["ordinal"].to_numpy() - start] = seen["p"]
    low, high = int(block["low"].iloc[0]), int(block["high"].iloc[0])
    out = []
    right = np.flatnonzero(no // TILE == high)
    for i in np.flatnonzero(no // TILE == low).tolist():
        others = right[no[right] > no[i]]
        if len(others):
            total = np.abs(share[others] - share[i]).sum(axis=1)
            out.append(pd.DataFrame({"a": no[i], "b": no[others], "value": total}))
    done = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": []}, dtype="int64")
    return done.assign(lang=block["lang"].iloc[0])[["lang", "a", "b", "value"]]


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of part ``pair``."""
    start = lambda x: F.expr(f"{x} div {TERMS} * {TERMS}")
    seen = join_small(counts, groups.select("lang", "source", "no", "total", "v", "tiles"), ["lang", "source"], "inner")
    seen = seen.select("lang", "no", "v", "tiles", start("ordinal").alias("start"), "ordinal", _share(F.col("n"), F.col("total")).alias("p"))
    lacks = groups.select(
        "lang", "no", "v", "tiles",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("v") - 1, F.lit(0)), F.lit(TERMS).cast("long"))).alias("start"),
        F.lit(-1).cast("long").alias("ordinal"),
        F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"))).otherwise(F.lit(0)).alias("p"),
    )
    tile = F.expr(f"no div {TILE}")
    cells = seen.unionByName(lacks).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cells = cells.withColumns({"low": F.least(tile, "other"), "high": F.greatest(tile, "other")}).drop("other", "tiles")
    sums = cells.groupBy("lang", "start", "low", "high").applyInPandas(
        _compared, "lang string, a bigint, b bigint, value bigint"
    ).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = cut(sums, "audit-sums")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda no, out: groups.select("lang", F.col("no").alias(no), F.col("source").alias(out))
    both = join_small(both, cut(name("a", "source"), "audit-names"), ["lang", "a"], "inner")
    both = join_small(both, cut(name("b", "item"), "audit-names"), ["lang", "b"], "inner")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def _terms(counts: DataFrame, groups: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """Rows of part ``term``."""
    all_ = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    rows = join_small(counts, cut(groups.join(all_, "lang").select("lang", "source", "total", "all", "v"), "audit-totals"),
                      ["lang", "source"], "inner")
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("m"))
    over = (_share(F.col("n"), F.col("total")) - _share(F.col("m"), F.col("all"))).alias("value")
    rows = rows.join(whole, ["lang", "ordinal"]).select("lang", "source", "ordinal", over).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = cut(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "audit-top")
    named = best.join(kept.select("lang", "ordinal", F.col("term").alias("item")), ["lang", "ordinal"])
    return named.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text",
                  lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: how far sources of one language are apart, and
    which terms each source uses more than its language does.

    Null text, language and source count as empty strings, which are values
    like others.  Texts without a term, and languages without a kept one, still
    have their groups; the distances of the latter are 0.  Repeated rows count
    as often as they occur.  Ties are ordered by the UTF-8 bytes of the item.
    Texts may be of any length: one is held at a time.  An empty table gives an
    empty one; other columns are not read.
    """
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"),
                       F.col(f"`{text}`").cast("binary").alias("text"))
    kept = vocabulary(rows, least_docs)
    counts = cut(recounted(rows, transducers(kept)), "audit-recounted")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    all_of = Window.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = cut(
        groups.select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"),
            (F.row_number().over(all_of.orderBy("source")) - 1).cast("long").alias("no"),
            F.expr(f"(count(*) OVER (PARTITION BY lang) + {TILE - 1}) div {TILE}").alias("tiles"),
        ),
        "audit-groups",
    )
    return _pairs(counts, groups).unionByName(_terms(counts, groups, kept, top))
