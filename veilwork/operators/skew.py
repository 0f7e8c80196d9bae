"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilwork.operators.rows import fresh

BROADCAST_BYTES = 32 << 20
PEEK_ROWS = 2_000_000


def peek(df: DataFrame, rows: int, wanted: int = PEEK_ROWS) -> tuple[DataFrame, float]:
    """About ``wanted`` of the rows, and the share they are.

    Only to choose where to cut or what to spread; never to compute a result.
    """
    share = min(1.0, wanted / max(rows, 1))
    return (df.sample(share, seed=17) if share < 1 else df), share


def hot_keys(df: DataFrame, key_hash: Column, rows_per_part: int = 1_000_000) -> DataFrame:
    """(h, parts) of the keys that hold more than ``rows_per_part`` rows.

    ``parts`` says over how many tasks such a key is spread, each of about that
    many rows whatever the size of the table.  Large tables are judged by a
    sample: a key that is missed is joined all the same, only not spread.
    There are at most ``PEEK_ROWS / 20`` such keys.
    """
    hashes = df.select(key_hash.alias("h"))
    rows = hashes.count()
    seen, part = peek(hashes, rows)
    unit = max(rows_per_part * part, 20.0 if part < 1 else 1.0)
    counts = seen.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > unit)
    return counts.select("h", F.ceil(F.col("n") / unit).cast("int").alias("parts"))


def salted_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str = "left",
    rows_per_part: int = 1_000_000,
) -> DataFrame:
    """Equi-join on ``key``, where ``right`` has each key once.

    Rows of a hot key are spread over several parts by the hash of
    ``spread_by``; the one right row of that key is repeated once per part.
    The salt hangs on row content alone, so a task that is run again puts
    every row where it was before.
    """
    h, n, at = (fresh(name, left, right) for name in ("_h", "_parts", "_salt"))
    hot = F.broadcast(hot_keys(left, F.xxhash64(key), rows_per_part).toDF(h, n))
    parts = F.coalesce(n, F.lit(1))
    marked = lambda df: df.withColumn(h, F.xxhash64(key)).join(hot, h, "left")
    salt = F.pmod(F.xxhash64(spread_by, F.lit(7)), parts).cast("int")
    salted = marked(left).withColumn(at, salt).drop(h, n)
    repeated = marked(right).withColumn(at, F.explode(F.sequence(F.lit(0), parts - 1))).drop(h, n)
    return salted.join(repeated, [key, at], how).drop(at)


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join with a table that is broadcast if its strings and rows are few bytes, which is measured."""
    width = F.lit(16)
    for field in right.schema.fields:
        column = F.col(f"`{field.name}`")
        is_text = field.dataType.simpleString() in ("string", "binary")
        width = width + (F.coalesce(F.octet_length(column), F.lit(0)) if is_text else F.lit(0)) + 16
    bytes_ = right.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()["b"]
    if bytes_ <= max_bytes:
        return left.join(F.broadcast(right), key, how)
    return salted_join(left, right, key, spread_by, how)
