"""Where texts come from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_texts(
    spark: SparkSession, path: str, fmt: str, id_col: str, text_col: str, keep: Iterable[str] = (),
    parts: int | None = None, **options,
) -> DataFrame:
    """Id and text of a stored table; no other column is read unless kept.

    Any format Spark reads will do.  ``fmt='text'`` has one text per line and
    no id: give the name of a column to make the id from, or ``_line`` for a
    hash of the line's file and text.
    """
    df = spark.read.format(fmt).options(**options).load(path)
    if fmt == "text" and id_col == "_line":
        df = df.withColumn("_line", F.xxhash64(F.col("_metadata.file_path"), F.col("value")))
        text_col = "value"
    return spread(df.select(id_col, F.col(text_col).alias("text"), *keep), parts)


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Deal a table out over ``parts`` tasks, if a number is given.

    Splits come from ``spark.sql.files.maxPartitionBytes``, and texts are not
    shuffled.  A small table in one file is one task all the same, and the
    detectors are all computing: ``veilwork.deal`` in the session, or the
    argument, deals out such tables.  Local sessions set it.
    """
    parts = parts or int(df.sparkSession.conf.get("veilwork.deal", "0"))
    return df.repartition(parts) if parts else df


def stream_texts(
    spark: SparkSession, path: str, fmt: str, schema: str, files_per_trigger: int | None = None, **options
) -> DataFrame:
    """The same tables as a file stream; the schema has to be given."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def texts_from_values(spark: SparkSession, texts: str | Iterable[str]) -> DataFrame:
    """One text or a list of texts as a table, numbered in list order."""
    if isinstance(texts, str):
        texts = [texts]
    return spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
