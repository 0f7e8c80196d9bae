"""What the operators share: words, intermediate tables, joins with a checked side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilwork.operators.rows import quoted
from veilwork.session import run_dir

#: Words are runs of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")


def packed(df: DataFrame, but: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """All columns (``but`` some) as one struct ``row`` beside others of any name, so that none can clash."""
    row = F.struct(*[F.col(c) for c in quoted(df.columns, but)])
    return df.select(row.alias("row"), *[c.alias(name) for name, c in more.items()])


def unpacked(names: list[str], **new: Column) -> list[Column]:
    """The columns of these names from ``row``, those given here instead of its own."""
    return [new[c].alias(c) if c in new else F.col(f"row.{q}").alias(c) for c, q in zip(names, quoted(names))]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a dear column behind a one-row generator, so that it is worked out once per row.

    Spark would else put the expression in place of each use, also inside lambdas.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lost executors cost no more than one stage."""
    path = run_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def width(df: DataFrame) -> int:
    """Bytes of a table's values, from one pass over it."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(column), F.lit(0)) + 16
        elif kind.startswith(("array", "struct", "map")):
            size = size + F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0)) + 16
        else:
            size = size + 16
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a written table: broadcast if its bytes are measured to be few, else by a
    shuffle, of which Spark splits the large partitions (adaptive skew join)."""
    if width(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)
