"""Adding columns and unrolling arrays without working anything out twice.

Spark moves a filter on a plain column below the column, with the whole
expression put in the filter's place for each use; and in front of a plain
``explode`` it puts a test of the array's size.  With expressions as dear as
the detectors both double the work.  Filters are not moved below a generator,
and its outer form gets no size test.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def quoted(names: Iterable[str], but: Iterable[str] = ()) -> list[str]:
    """Column names, without some, as they have to be written in SQL."""
    left_out = set(but)
    return ["`" + n.replace("`", "``") + "`" for n in names if n not in left_out]


def fresh(name: str, *tables: DataFrame) -> str:
    """A name like this one that no column of the tables has, in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_once(df: DataFrame, out: str, sql: str) -> DataFrame:
    """Add a column whose dear expression is worked out once per row."""
    return df.selectExpr(*quoted(df.columns, but=[out]), f"explode(array({sql})) AS {out}")


def unroll(df: DataFrame, array: str, number: str, *keys: str) -> DataFrame:
    """One row per element ``e`` of an array expression, with its number."""
    rows = df.selectExpr(*keys, f"posexplode_outer({array}) AS ({number}, e)")
    return rows.where(F.col(number).isNotNull())
