"""Batches: numbering, sizing and the batch job."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F, types as T

from veilwork import functions as vf
from veilwork.functions import rules
from veilwork.operators.injection import DECISION_FIELDS, detect_prompt_injection
from veilwork.operators.model import RetryPolicy, score_with_model
from veilwork.operators.pii import mask_pii
from veilwork.operators.ranges import dealt_by_range, with_totals_before
from veilwork.operators.rows import fresh, quoted
from veilwork.operators.skew import PEEK_ROWS, peek
from veilwork.sources import responses

MAX_SLOTS = 20_000
#: What the batch job adds; columns of these names give way.
STATE_FIELDS = ("latency_seconds", "error", "status")
RESULT_FIELDS = {"mask_pii": ("masked_text", "entities"), "detect_injection": DECISION_FIELDS}
NUMBERS = ("position", "batch_no", "n_batches")


def assign_batches(
    df: DataFrame,
    key: str,
    size: int = rules.DEFAULT_BATCH_SIZE,
    tie: str | None = None,
    rows_per_slot: int = 200_000,
) -> DataFrame:
    """Number the rows in key order and cut the numbering into batches.

    Adds ``position`` (from 0), ``batch_no`` (from 1) and ``n_batches``.  The
    key is numeric, a date or a timestamp; key and ``tie`` together identify a
    row; columns of the names added give way.  There is no global sort: quantiles of the key cut the table into
    slots, rows are numbered inside their slot, and the row counts of the
    slots before it are added.  A key value so frequent that it fills several
    slots is spread over that many by the hash of ``tie``, or of the whole row
    where none is given.

    The counts and the numbering are two passes that must see the same rows,
    so ``df`` has to be repeatable, as a stored table is.
    """
    key_type = df.schema[key].dataType
    if not isinstance(key_type, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError("the order key must be numeric, a date or a timestamp")
    if size < 1:
        raise ValueError("size must be at least 1")
    order = F.col(key) if isinstance(key_type, T.NumericType) else F.unix_micros(F.col(key).cast("timestamp"))

    narrow = df.select(order.alias("k"))
    n, n_null = narrow.agg(F.count("*"), F.count_if(F.col("k").isNull())).first()
    n_slots = max(1, min(MAX_SLOTS, n // rows_per_slot))
    bounds = []
    if n_slots > 1:
        steps = [i / n_slots for i in range(1, n_slots)]
        # wherever the cuts fall the numbers are right; a sample cuts evenly enough
        seen, _ = peek(narrow, n, max(PEEK_ROWS, 100 * n_slots))
        found = seen.agg(F.percentile_approx("k", steps, max(10_000, 4 * n_slots)).alias("b"))
        bounds = list(found.first()["b"] or [])
    null_parts = max(1, n_null * n_slots // max(n, 1))

    # rows of one content may stand for each other, so the hash of the row will do as a tie
    told_by = quoted([tie]) if tie else [
        q for f, q in zip(df.schema.fields, quoted(df.columns)) if "map<" not in f.dataType.simpleString()
    ]
    # the row travels as one struct, so that no column of it meets one of these
    slotted = df.select(
        F.struct(*quoted(df.columns, but=NUMBERS)).alias("row"), order.alias("k"),
        F.shiftrightunsigned(F.xxhash64(*told_by), 33).cast("bigint").alias("spread"),
        *([F.col(quoted([tie])[0]).alias("tie")] if tie else []),
    )
    slotted = slotted.withColumn("at", F.expr(_slot("k", bounds, null_parts, key_type)))
    slotted = slotted.withColumn("slot", F.col("at.slot")).withColumn(
        "part", F.expr("CAST(spread * at.parts DIV 2147483648 AS int)")
    )

    here = Window.partitionBy("slot", "part").orderBy("k", "spread", *(["tie"] if tie else []))
    # at most three rows per slot
    before = Window.orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        slotted.groupBy("slot", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    # a left join: for an inner one Spark puts a null test of the slot in front,
    # which would work it out twice
    return (
        slotted.withColumn("no", F.row_number().over(here))
        .join(F.broadcast(counts), ["slot", "part"], "left")
        .withColumn("position", F.col("before") + F.col("no") - 1)
        .select(
            *[f"row.{c}" for c in quoted(df.columns, but=NUMBERS)],
            "position",
            F.expr(f"position DIV {size} + 1").alias("batch_no"),
            F.lit(-(-n // size)).cast("bigint").alias("n_batches"),
        )
    )


def number_rows(df: DataFrame, key: str, tie: str, size: int = rules.DEFAULT_BATCH_SIZE) -> DataFrame:
    """(key, tie, position, batch_no) of every row: the numbers of ``assign_batches`` without the rows.

    Only the two columns are shuffled, into ranges that Spark draws: as many as
    the session has partitions, with nothing of them in the plan.  The key may be
    of any type that sorts; NULL comes first.  Join the numbers to the texts, by
    key and tie, where texts are needed.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    narrow = df.select(F.col(quoted([key])[0]).alias("k"), F.col(quoted([tie])[0]).alias("t"))
    order = [F.asc_nulls_first("k"), F.asc_nulls_first("t")]
    numbered = with_totals_before(dealt_by_range(narrow, order, "numbers"), order, {"position": F.lit(1)})
    return numbered.select(
        F.col("k").alias(key), F.col("t").alias(tie), "position", F.expr(f"position DIV {size} + 1").alias("batch_no")
    )


def _number(value) -> str:
    """A number as SQL; NaN and infinity have no literals."""
    return f"double('{value}')" if isinstance(value, float) and not math.isfinite(value) else str(value)


def _slot(key: str, bounds: list, null_parts: int, key_type: T.DataType) -> str:
    """Slot of a key, and the number of parts the slot is spread over.

    Finds the last bound not above the key by halving steps.  Rows equal to
    the bound and rows above it are two slots: the first holds one key only,
    so it can be spread without breaking the order, over as many parts as
    the bound is repeated.
    """
    if not bounds:
        return f"named_struct('slot', IF({key} IS NULL, -1, 0), 'parts', 1)"
    kind = key_type.simpleString() if isinstance(key_type, T.NumericType) else "bigint"
    repeats, run = [], 0
    for i, b in enumerate(bounds):
        run = run + 1 if i and b == bounds[i - 1] else 1
        repeats.append(run)
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    array = f"CAST(array({', '.join(_number(b) for b in bounds)}) AS array<{kind}>)"
    parts = f"array({', '.join(map(str, repeats))})"
    found = (
        f"aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> "
        f"IF(at + step <= {len(bounds)} AND get(b, at + step - 1) <= {key}, at + step, at))"
    )
    on_bound = f"at > 0 AND get(b, at - 1) = {key}"
    return (
        f"transform(array({array}), b -> transform(array({found}), at -> CASE "
        f"WHEN {key} IS NULL THEN named_struct('slot', -1, 'parts', {null_parts}) "
        f"WHEN {on_bound} THEN named_struct('slot', 2 * at, 'parts', get({parts}, at - 1)) "
        "ELSE named_struct('slot', 2 * at + 1, 'parts', 1) END)[0])[0]"
    )


def adaptive_batch_size(df: DataFrame, text_col: str = "text", by: str | None = None) -> DataFrame:
    """Batch size from the mean text length: short texts, large batches."""
    mean = F.avg(F.length(text_col))
    grouped = df.groupBy(by) if by else df
    out = grouped.agg(F.count("*").alias("n_texts"), mean.alias("mean_chars"))
    size = None
    for below, batch in rules.BATCH_SIZE_STEPS:
        test = F.col("mean_chars") < below
        size = F.when(test, batch) if size is None else size.when(test, batch)
    return out.withColumn("batch_size", size.otherwise(rules.BATCH_SIZE_ELSE))


def batch_process(
    df: DataFrame,
    operation: str,
    text_col: str = "text",
    batch_size: int = rules.DEFAULT_BATCH_SIZE,
    make_model: Callable[[], Callable] | None = None,
    retry: RetryPolicy | None = None,
    return_entities: bool = True,
    threshold: float = rules.INJECTION_THRESHOLD,
    merge_tags: bool = False,
    token_budget: int | None = None,
) -> DataFrame:
    """Run one operation over a table; no row is lost.

    Without a model the rules answer.  With one, texts go to it in batches;
    a batch that fails, or an answer that cannot be read, gives failed rows.
    ``merge_tags`` joins the B-/I- tags of a model that answers by token;
    ``token_budget`` bounds a batch's longest text times its texts, in words.
    """
    operation = {"detect_prompt_injection": "detect_injection"}.get(operation, operation)
    if operation not in rules.OPERATIONS:
        raise ValueError(f"operation must be one of {', '.join(rules.OPERATIONS)}")
    keep = quoted(df.columns, but=RESULT_FIELDS[operation] + STATE_FIELDS)
    if make_model is None:
        if operation == "mask_pii":
            out = mask_pii(df, text_col, return_entities)
        else:
            out = detect_prompt_injection(df, text_col, threshold)
        return out.withColumns(
            {
                "latency_seconds": F.lit(None).cast("double"),
                "error": F.lit(None).cast("string"),
                "status": F.lit(rules.STATUS_OK),
            }
        )

    scored = score_with_model(df, text_col, make_model, batch_size, retry or RetryPolicy(), token_budget)
    state = list(STATE_FIELDS)
    if operation == "mask_pii":
        at = fresh("_found", scored)
        parsed = _checked(responses.parse_entities(scored, "response", at), text_col, at)
        if merge_tags:
            parsed = parsed.withColumn(at, vf.merge_bio(text_col, at))
        done = F.col("status") == rules.STATUS_OK
        result = [F.when(done, vf.apply_mask(text_col, at)).alias("masked_text")]
        if return_entities:
            result.append(F.when(done, vf.extract_entities(at)).alias("entities"))
        return parsed.select(*keep, *result, *state)
    at = fresh("_labels", scored)
    parsed = _checked(responses.parse_labels(scored, "response", at), text_col, at)
    judged = detect_prompt_injection(parsed, text_col, threshold, labels_col=at)
    done = F.col("status") == rules.STATUS_OK
    return judged.select(*keep, *[F.when(done, F.col(c)).alias(c) for c in DECISION_FIELDS], *state)


def _checked(parsed: DataFrame, text_col: str, col: str) -> DataFrame:
    """Unreadable answers are failures; a NULL text has no answer and is none."""
    unreadable = F.col(col).isNull() & F.col(text_col).isNotNull()
    error = F.coalesce("error", F.when(unreadable, F.lit(responses.MALFORMED)))
    return parsed.withColumn("error", error).withColumn(
        "status",
        F.when(F.col("error").isNotNull(), rules.STATUS_FAILED).otherwise(rules.STATUS_OK),
    )
