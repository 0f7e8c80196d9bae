"""Spelling variants: words one edit apart, joined by asymmetric q-chunks.

Of two words the shorter one (of equal lengths, the smaller) contributes two
disjoint chunks: its first and its last half.  One edit touches one chunk at
most, so the other is a positional gram of the longer word: unshifted if it lies
in front of the edit, and shifted by the difference of the lengths (none or one)
behind it.  Of the longer word's positional grams only those at these two places
can therefore meet a chunk, and only they are made.  Pairs that meet are
verified by the edit distance.

Halves of short words are crowded: many words begin alike.  Where a chunk would
make many more pairs than it has rows, what is left of its words is chunked in
the same way, and the pair has to meet in a chunk of that too.  This goes on
until no chunk is crowded, or nothing but the edited place is left open.  No
pair gets lost on the way and none is left out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from veilwork.llm.common import cut, join_small

#: Letters of a run: ASCII letters and the code points U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
#: One occurrence in so many loses a code point.
TYPO = 199
#: Pairs that a chunk may make per row it has.
CROWDED = 16


def occurrences(docs: DataFrame, least: int, key: str, text: str) -> DataFrame:
    """(word) of every occurrence of ``least`` code points or more, after the planted typos."""
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN), F.lit(0))
    run = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")
    ).where(F.length("run") >= least)
    low = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    run = run.select("id", low.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    run = run.select("run", h.alias("h"))
    at = F.expr("CAST(h % length(run) AS int)")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % TYPO == 0, shorter).otherwise(F.col("run"))
    return run.select(word.alias("word")).where(F.length("word") >= least)


def _key() -> Column:
    """What the two words of a pair share: ``head`` code points in front, ``tail`` at the end."""
    end = F.expr("substring(w, length(w) - tail + 1, tail)")
    return F.xxhash64("size", "head", "tail", F.expr("substring(w, 1, head)"), end)


def _chunked(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first and with the last half of what is open added."""
    half = F.greatest(F.expr("(size - head - tail) div 2").cast("int"), F.lit(1))
    both = rows.withColumn("more", F.explode(F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + half).alias("tail")),
    )))
    grown = both.select("w", "gram", "size", F.col("more.head").alias("head"), F.col("more.tail").alias("tail"))
    return grown.select("*", _key().alias("k"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of the words (``word``: distinct, not null, two code points or more) that are one
    edit apart, each pair once.

    ``a`` is the shorter word, or the smaller of two of one length.
    """
    size = F.length("word")
    none = F.lit(0)
    # the chunks of a word, and its grams where a word of its length or one less has its chunks
    roles = F.explode(F.array(
        F.struct(F.lit(False).alias("gram"), size.alias("size")),
        F.struct(F.lit(True).alias("gram"), size.alias("size")),
        F.struct(F.lit(True).alias("gram"), (size - 1).alias("size")),
    ))
    rows = words.select(F.col("word").alias("w"), roles.alias("r")).where("r.size > 1")
    rows = _chunked(rows.select("w", "r.gram", "r.size", none.alias("head"), none.alias("tail")))
    found = words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    while True:
        rows = cut(rows, "spelling-chunks")
        met = rows.groupBy("k").agg(
            F.count_if(~F.col("gram")).alias("c"), F.count_if("gram").alias("g"),
            F.max(F.expr("size - head - tail")).alias("open"),
        )
        crowded = met.where((F.col("c") * F.col("g") > CROWDED * (F.col("c") + F.col("g"))) & (F.col("open") > 1))
        crowded = cut(crowded.select("k"), "spelling-crowded")
        free = join_small(rows, crowded, ["k"], "left_anti")
        a = free.where("NOT gram").select("k", F.col("w").alias("a"))
        b = free.where("gram").select("k", F.col("w").alias("b"))
        ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
        pairs = a.join(b, "k").where(ordered & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
        found = found.unionByName(cut(pairs, "spelling-pairs"))
        if crowded.isEmpty():
            return found.distinct()
        rows = _chunked(join_small(rows, crowded, ["k"], "left_semi"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form; the path to the root is halved each round."""
    at = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                        F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_size: int = 6,
                      least_count: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word of the texts.

    Words are maximal runs of letters, A-Z lower-cased, of at least
    ``least_size`` code points and ``least_count`` occurrences in the whole
    table.  One occurrence in 199 (told by a checksum of key and run) has lost
    a code point.  A word's form is its most frequent near word (ties: the
    smallest), if that is ``ratio`` times as frequent; its root is where its
    forms lead.  Null texts have no words; a null key counts as an empty one;
    repeated rows count as often as they occur; an empty table gives an empty
    one; other columns are not read.
    """
    if least_size < 2:
        raise ValueError("least_size must be at least 2")
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could go in circles")
    counted = occurrences(docs, least_size, key, text).groupBy("word").agg(F.count("*").alias("n"))
    words = cut(counted.where(F.col("n") >= least_count), "spelling-words")
    pairs = cut(near_pairs(words.select("word")), "spelling-near")
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b")))
    near = sides.join(named, "b").groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), best.alias("best")
    )
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.m") >= ratio * F.col("n"), F.struct(F.col("best.b").alias("form"), (-F.col("best.m")).alias("n"))).alias("to"),
    )
    judged = cut(judged, "spelling-judged")
    roots = _roots(judged.where("to IS NOT NULL").select("word", F.col("to.form").alias("form")))
    return judged.join(roots, "word", "left").select(
        "word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.col("to.n").alias("form_n"),
    )
