"""Token limits of a model service: batches under a budget, and chunks by tokens.

A token is a word here (a run of anything but white space) unless the caller
gives an expression of its own.  A batch costs what its rows cost padded to the
longest: longest times count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.functions import rules
from veilwork.functions.sqltext import let, running
from veilwork.functions.text import hash_number
from veilwork.operators.rows import quoted, unroll

_WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space behind it, and with that at the beginning of the text.
_PIECE = r"(?:\A[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"

#: What ``token_batches`` adds; columns of these names give way.
BATCH_FIELDS = ("n_tokens", "batch_id", "batch_rows", "batch_longest", "batch_cost")


def count_words(text_col: str = "text") -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0))


def token_batches(
    df: DataFrame,
    key: str,
    tokens: Column | str,
    budget: int = rules.MAX_BATCH_TOKENS,
    max_rows: int = rules.MAX_BATCH_ROWS,
    rows_per_slot: int = 200_000,
) -> DataFrame:
    """Number the rows into batches whose padded cost keeps to the budget.

    Adds ``n_tokens``, ``batch_id``, ``batch_rows``, ``batch_longest`` and
    ``batch_cost``.  Rows of which the same number fits into the budget form a
    class; that many of them make a batch, whichever they are, so batches are
    cut by row number and need no running sum.  A row over the budget is a batch
    of its own.  Inside a class rows are sorted by length, which keeps the
    padding small, over slots of about ``rows_per_slot`` rows (dealt by a hash
    of the key): no global sort, and a class of any size is spread out.

    The key tells rows apart and is not NULL.  ``df`` must be repeatable, as a
    stored table is, since the classes are counted first (at most ``max_rows``
    of them).  Everything ``df`` holds is shuffled: give it key and counts alone
    where the texts are not needed.
    """
    if budget < 1 or max_rows < 1:
        raise ValueError("budget and max_rows must be at least 1")
    counted = F.expr(tokens) if isinstance(tokens, str) else tokens
    row = df.select(F.struct(*quoted(df.columns)).alias("row"), F.greatest(F.coalesce(counted, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    fits = F.expr(f"least({max_rows}L, greatest(1L, {budget}L div greatest(n, 1L)))")
    row = row.withColumn("fits", fits)
    slots = row.groupBy("fits").agg(F.ceil(F.count("*") / F.lit(rows_per_slot)).alias("slots"))
    row = row.join(F.broadcast(slots), "fits")  # a row a class, max_rows at most
    row = row.withColumn("slot", F.expr(f"{hash_number('row.`' + key.replace('`', '``') + '`', 'slot')} % slots"))
    order = Window.partitionBy("fits", "slot").orderBy(F.desc("n"), F.col(f"row.`{key}`"))
    row = row.withColumn("batch", F.floor((F.row_number().over(order) - 1) / F.col("fits")))
    batch = Window.partitionBy("fits", "slot", "batch")
    packed = row.select(
        "row", F.col("n").alias("n_tokens"), F.concat_ws("-", "fits", "slot", "batch").alias("batch_id"),
        F.count("*").over(batch).alias("batch_rows"), F.max("n").over(batch).alias("batch_longest"),
    )
    return packed.select(
        *[f"row.{c}" for c in quoted(df.columns, but=BATCH_FIELDS)], *BATCH_FIELDS[:-1],
        (F.col("batch_rows") * F.col("batch_longest")).alias("batch_cost"),
    )


def chunk_tokens(
    df: DataFrame, text_col: str = "text", max_tokens: int = rules.MAX_INPUT_TOKENS, overlap: int = 128
) -> DataFrame:
    """One row per piece: its number, its offset in the text, the piece and its words.

    Pieces begin and end between words, so none is cut, and none has more than
    ``max_tokens`` words.  Every character is in some piece, and what spans no
    more than ``overlap`` words is whole in at least one.  ``chunk_start`` is the
    sum of the lengths of the words before, so ``lift_spans`` gives spans of
    whole texts.  A text without words is one piece; a NULL text has none.
    Other columns stay; the text goes.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be at least 0 and less than max_tokens")
    step = max_tokens - overlap
    words = f"regexp_extract_all({text_col}, r'{_PIECE}', 0)"
    last = f"greatest(CAST(ceil((size(w) - {max_tokens}) / {step}) AS int), 0)"
    # lengths of the strides between the starts of pieces; their prefix sums are the starts
    lengths = (
        f"transform(sequence(0, {last}), i -> aggregate(slice(w, i * {step} + 1, {step}), 0, "
        "(n, x) -> n + length(x)))"
    )
    pieces = (
        "transform(st, (s, i) -> named_struct('chunk_start', s, "
        f"'chunk', array_join(slice(w, i * {step} + 1, {max_tokens}), ''), "
        f"'n_tokens', size(slice(w, i * {step} + 1, {max_tokens}))))"
    )
    starts = let("ln", lengths, running("ln", "0", "q.l + x"))
    none = f"array(named_struct('chunk_start', 0, 'chunk', {text_col}, 'n_tokens', 0))"
    cut = let("w", words, f"IF(size(w) = 0, {none}, {let('st', starts, pieces)})")
    keep = quoted(df.columns, but=[text_col])
    return unroll(df, f"IF({text_col} IS NULL, NULL, {cut})", "chunk_no", *keep).select(
        *keep, "chunk_no", "e.chunk_start", "e.chunk", "e.n_tokens"
    )
