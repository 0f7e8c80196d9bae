"""Answers that outlive a run: a stored table of them, by text digest and model version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilwork.operators.rows import quoted
from veilwork.operators.skew import lookup_join, salted_join
from veilwork.session import run_dir

#: Columns of the store besides the answer.
VERSION, DIGEST = "model_version", "text_digest"
#: In front of a version in the name of its folder, so that none is read back as a number.
_PREFIX = "version-"


def text_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stored_answers(spark: SparkSession, store: str, version: str) -> DataFrame | None:
    """(text_digest, answer) of one model version, each digest once; None without a store.

    Two runs that met the same new text at once have both stored an answer; the
    least is taken, so that all readers take the same.
    """
    try:
        rows = spark.read.parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    mine = rows.where(F.col(VERSION) == _PREFIX + version)
    return mine.groupBy(DIGEST).agg(F.min("answer").alias("answer"))


def score_with_store(
    df: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    store: str,
    version: str,
    key: str,
    text_col: str = "text",
    rows_per_part: int = 1_000_000,
) -> DataFrame:
    """Add ``answer`` (JSON of what ``scorer`` adds) and ``reused`` to every row with a text.

    ``scorer`` takes a table (``text_digest``, ``text``) of distinct texts and
    adds columns to it.  It gets only texts whose digest the store does not hold
    for this version; their answers are appended in one commit.  A run that
    fails before it leaves the store as it was, and one that is repeated after
    it finds its answers there: no text is scored twice.  Versions do not see
    each other's answers.  A scorer that is to try failed texts again leaves
    them out of its result: their answer is NULL and nothing is stored.

    NULL texts get no answer.  Digests and one copy of each new text are
    shuffled; the answers come back by the digest, those of a text with many
    copies spread over parts.  Columns of the names added give way.  The work is
    done when the function is called, and the result reads the store.
    """
    spark = df.sparkSession
    (text,), (name,) = quoted([text_col]), quoted([key])
    digest = text_digest(F.col(text))
    known = stored_answers(spark, store, version)
    texts = df.select(digest.alias(DIGEST), F.col(text).alias("text"), F.xxhash64(name).alias("spread"))
    texts = texts.where(f"{DIGEST} IS NOT NULL")
    if known is not None:
        # what is known is left out before any text is shuffled
        path = run_dir(spark, "new-digests")
        texts.select(DIGEST).distinct().join(known, DIGEST, "left_anti").write.parquet(path)
        texts = lookup_join(texts, spark.read.parquet(path), DIGEST, "spread")
    answered = scorer(texts.groupBy(DIGEST).agg(F.first("text").alias("text")))
    added = [c for c in answered.columns if c not in (DIGEST, "text")]
    if not added:
        raise ValueError("the scorer added no column")
    path = run_dir(spark, "answers")
    answered.select(DIGEST, F.to_json(F.struct(*quoted(added))).alias("answer")).write.parquet(path)
    fresh = spark.read.parquet(path)
    fresh.withColumn(VERSION, F.lit(_PREFIX + version)).write.mode("append").partitionBy(VERSION).parquet(store)
    marked = fresh.select(DIGEST, "answer", F.lit(False).alias("reused"))
    if known is not None:
        older = stored_answers(spark, store, version).join(fresh.select(DIGEST), DIGEST, "left_anti")
        marked = marked.unionByName(older.select(DIGEST, "answer", F.lit(True).alias("reused")))
    rows = df.select(F.struct(*quoted(df.columns)).alias("row"), digest.alias(DIGEST), F.xxhash64(name).alias("spread"))
    met = salted_join(rows, marked, DIGEST, spread_by="spread", rows_per_part=rows_per_part)
    keep = [f"row.{c}" for c in quoted(df.columns, but=("answer", "reused"))]
    return met.select(*keep, "answer", "reused")
