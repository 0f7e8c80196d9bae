"""Running totals over a whole table in the order of a key, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.operators.rows import quoted
from veilwork.session import run_dir


def dealt_by_range(df: DataFrame, order: list[Column], name: str = "ranges", parts: int | None = None) -> DataFrame:
    """The table in ranges of the order, with the range's number as ``part``, written once.

    Spark draws the bounds, and joins small ranges unless ``parts`` says how many
    there are.  Equal values are not split, so ``order`` should end in something
    that tells rows apart.  The written table is what both passes of a caller
    see, whatever is lost or run again.
    """
    path = run_dir(df.sparkSession, name)
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    ranged.withColumn("part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_totals_before(dealt: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Add for each name the sum of its column over all rows before this one (NULLs count as 0).

    ``dealt`` comes from ``dealt_by_range`` with the same order.  Sums are made
    inside the ranges, and the totals of the ranges before are added: they are a
    row a range (and a row for each value of ``by``, which totals are kept
    apart), and are broadcast.
    """
    by = list(by)
    value = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    totals = dealt.groupBy("part", *by).agg(*[F.sum(c).alias(f"{n}_sum") for n, c in value.items()])
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", *by, *[F.coalesce(F.sum(f"{n}_sum").over(earlier), F.lit(0)).alias(f"{n}_offset") for n in sums]
    )
    here = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"{n}_here") for n, c in value.items()])
    placed = local.join(F.broadcast(offsets), ["part", *by])
    keep = quoted(c for c in dealt.columns if c != "part")
    return placed.select(*keep, *[(F.col(f"{n}_offset") + F.col(f"{n}_here")).alias(n) for n in sums])
