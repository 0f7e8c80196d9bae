"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilwork.functions import rules
from veilwork.functions.text import hash_bucket


def capture_sample(
    df: DataFrame, key: str, pct: float = rules.CAPTURE_PERCENT, enabled: bool = True
) -> DataFrame:
    """The rows an audit keeps: a stable share of the keys.

    The choice hangs on the key alone, so a row is kept or left the same way
    in every run, in batch and in stream.
    """
    if not enabled:
        return df.where(F.lit(False))
    return df.where(F.expr(f"{hash_bucket(key, 'capture')} < {round(pct * 100)}"))


def write_capture(df: DataFrame, key: str, path: str, pct: float = rules.CAPTURE_PERCENT) -> None:
    capture_sample(df, key, pct).write.mode("append").parquet(path)


def write_routed(routed: DataFrame, base: str, mode: str = "errorifexists") -> None:
    """Blocked, masked and clean rows, each in a folder of its own."""
    routed.write.mode(mode).partitionBy("decision").parquet(base)
