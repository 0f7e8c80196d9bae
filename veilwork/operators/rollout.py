"""Traffic weights that change with time: each call goes by the weights of its moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veilwork.functions.text import hash_number
from veilwork.operators.rows import quoted
from veilwork.operators.skew import BROADCAST_BYTES


def assign_rollout(
    calls: DataFrame,
    weights: DataFrame,
    key: str,
    ts: str = "ts",
    out: str = "variant",
    bin_: str = "day",
) -> DataFrame:
    """Add the variant of each call, as of its time.

    ``weights`` has ``valid_from``, ``variant`` and ``weight``: from a moment on,
    until the next one given, calls are split in proportion to its weights.  A
    key is drawn for each variant by a hash of both, stretched by the weight, and
    takes the smallest draw: when one weight is raised, keys move to that variant
    only, and when it is lowered, only from it.  Weights of 0 or less and NULL
    get nothing.  Calls before the first moment, or without a time, get NULL; a
    column named ``out`` gives way.

    The moments are laid out over the time bins of the calls, so the as-of join
    is an equi-join by bin; its side is broadcast if its rows, which are counted,
    are few.
    """
    clean = weights.where("weight > 0 AND valid_from IS NOT NULL AND variant IS NOT NULL")
    shares = clean.groupBy(F.col("valid_from").cast("timestamp").alias("from")).agg(
        F.array_sort(F.collect_list(F.struct("variant", F.col("weight").cast("double").alias("weight")))).alias("shares")
    )
    # a row a moment; moments whose weights are all 0 are kept, with no variant
    every = weights.select(F.col("valid_from").cast("timestamp").alias("from")).where("from IS NOT NULL").distinct()
    spans = every.join(shares, "from", "left").select(
        "from", "shares", F.lead("from").over(Window.orderBy("from")).alias("to")
    )
    moment = F.col(quoted([ts])[0]).cast("timestamp")
    first, last = calls.agg(F.min(moment), F.max(moment)).first()
    binned = lambda c: F.date_trunc(bin_, c)
    until = F.least(F.coalesce(F.col("to"), F.lit(last).cast("timestamp")), F.lit(last).cast("timestamp"))
    since = F.greatest("from", F.lit(first).cast("timestamp"))
    laid = spans.select("from", "to", "shares", since.alias("a"), until.alias("b")).where("a <= b").select(
        "from", "to", "shares",
        F.explode(F.sequence(binned(F.col("a")), binned(F.col("b")), F.expr(f"INTERVAL 1 {bin_}"))).alias("bin"),
    )
    row_bytes = 64 + 48 * (weights.select("variant").distinct().count())
    if laid.count() * row_bytes <= BROADCAST_BYTES:
        laid = F.broadcast(laid)
    packed = calls.select(F.struct(*quoted(calls.columns)).alias("row"), moment.alias("at"))
    packed = packed.withColumns({"bin": binned(F.col("at")), "id": F.expr(f"CAST(row.{quoted([key])[0]} AS string)")})
    in_force = (packed["bin"] == laid["bin"]) & (F.col("at") >= F.col("from")) & (F.col("to").isNull() | (F.col("at") < F.col("to")))
    met = packed.join(laid, in_force, "left")
    draw = f"-ln(({hash_number('concat(s.variant, id)', 'rollout')} + 0.5D) / 4294967296D) / s.weight"
    best = F.expr(f"array_min(transform(shares, s -> named_struct('d', {draw}, 'v', s.variant))).v")
    return met.select(*[f"row.{c}" for c in quoted(calls.columns, but=[out])], best.alias(out))
