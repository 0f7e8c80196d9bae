"""Person names by a table of given names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilwork.functions import rules
from veilwork.functions.rules import PiiRule
from veilwork.functions.spans import raw_spans
from veilwork.functions.sqltext import let, running
from veilwork.operators.rows import unroll
from veilwork.operators.skew import lookup_join

# Capitalised words in a row: "Dear John Smith" offers "Dear John" and "John Smith".
_WORDS = PiiRule(
    "PERSON",
    "",
    r"(?<![0-9A-Za-z_\p{L}])\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+",
)


def detect_persons(
    df: DataFrame, names: DataFrame, key: str, text_col: str = "text", name_col: str = "name"
) -> DataFrame:
    """One row per given name of the table that a capitalised word follows.

    Only the key, the two words and the offset travel to the join, not the
    text.  The names are broadcast if few; many names are joined by shuffle,
    with the rows of a frequent name spread.
    """
    rows = unroll(df, raw_spans(text_col, (_WORDS,)), "_no", key)
    rows = rows.selectExpr(key, "e.start AS _from", "split(e.word, ' ') AS _ws")
    pairs = let("at", running("_ws", "0", "q.l + length(x) + 1"), (
        "transform(sequence(0, size(_ws) - 2), i -> named_struct("
        "'name', _ws[i], 'next', _ws[i + 1], 'start', _from + at[i]))"
    ))
    pairs = unroll(rows, pairs, "_i", key).select(
        key, F.col("e.name").alias("_name"), F.col("e.next").alias("_next"), F.col("e.start").alias("start")
    )
    given = names.select(F.col(name_col).alias("_name")).distinct()
    word = F.concat_ws(" ", "_name", "_next")
    return lookup_join(pairs, given, "_name", key).select(
        key,
        F.lit("PERSON").alias("type"),
        word.alias("text"),
        "start",
        (F.col("start") + F.length(word)).alias("end"),
        F.lit(rules.PII_RULES[-1].score).alias("confidence"),
    )
