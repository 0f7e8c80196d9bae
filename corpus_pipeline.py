"""The corpus pipeline: five stages over documents, each written and read again.

Every stage gets all that the one before it kept, and its decisions take
effect.  Null texts count as empty throughout; all columns of documents go
along, and columns that a stage needs for itself do not reach the next one.
An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.llm import bpe, minhash, mixing, surrogates, toxicity
from veilwork.llm.common import cut, join_small, packed, table, unpacked
from veilwork.llm.queries import LEVELS, WEIGHTS, tokenizer, with_domain


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; rows are judged one by one."""
    rows = packed(docs, but=("text",), doc_id=F.col("doc_id"), text=F.col("text"))
    scored = toxicity.with_score(rows, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < 0.5).select(*unpacked(docs.columns, text=F.col("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Rows are told apart by id and text, so one id may stand for several texts.
    Rows without an id take part, and stay only where no row of their group has
    one.  Texts without a word are no copies of each other and all stay.  Rows
    that repeat id and text are copies too, and one of them stays.
    """
    # no field is null, and rows without an id come last
    told = F.struct(
        F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"),
    )
    known = packed(docs, told=told)
    judged = minhash.near_duplicates(known.select("told", "row.text"), n=5, percent=80, key="told")
    judged = cut(judged, "pipeline-near")
    gone = cut(judged.where(~F.col("kept")).select("told").distinct(), "pipeline-gone")
    kept = join_small(known, gone, ["told"], "left_anti")
    again = cut(
        judged.where("kept AND n_shingles > 0").groupBy("told").agg(F.count("*").alias("n"))
        .where("n > 1").select("told"),
        "pipeline-again",
    )
    if again.isEmpty():
        return kept.select(*unpacked(docs.columns))
    once = join_small(kept, again, ["told"], "left_anti")
    repeated = join_small(kept, again, ["told"], "left_semi")
    return once.unionByName(repeated.dropDuplicates(["told"])).select(*unpacked(docs.columns))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; all rows stay."""
    rows = packed(docs, but=("text",), doc_id=F.col("doc_id"), text=F.col("text"))
    replaced = surrogates.replace_entities(rows, secret="veilwork-corpus-1")
    size = F.length("text").cast("long")
    return replaced.select(*unpacked(docs.columns, text=F.col("text"), n_chars=size))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its leaf's budget takes it."""
    rows = packed(docs, doc_id=F.col("doc_id"), lang=F.col("lang"), source=F.col("source"),
                  n_words=mixing.count_words(F.col("text")))
    mixed = mixing.mix_to_weights(with_domain(rows), LEVELS, WEIGHTS, budget_share=0.9, seed=17, tokens="n_words")
    taken = mixed.where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*unpacked(docs.columns))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of what they decode to."""
    texts = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode_checked(texts, tokenizer("byte_bpe_50k.json"), with_ids=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", replace_private),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

#: SQL has no trained scores, surrogates or byte-pair merges; the tests hold the stages
#: against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name.replace(' ', '-')}")
    return docs
