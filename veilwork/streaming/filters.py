"""Content filter and chat moderation on streams.

The batch operators are row by row, so they run on streams as they are; no
state is kept.  The file sink commits each micro-batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilwork.functions import rules
from veilwork.operators.injection import dual_filter, moderate_chat
from veilwork.operators.rows import quoted


def _write(out: DataFrame, path: str, checkpoint: str, available_now: bool, by: str) -> StreamingQuery:
    writer = (
        out.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(by)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def filter_stream(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    text_col: str = "text",
    threshold: float = rules.INJECTION_THRESHOLD,
    available_now: bool = False,
) -> StreamingQuery:
    """Blocked, masked and clean messages, each in a folder of its own.

    Of a message with personal data only the masked text is written, and of a
    clean one the text is the masked text; the original of a blocked message
    is kept for review.
    """
    routed = dual_filter(messages, text_col, threshold)
    kept = routed.selectExpr(
        *quoted(routed.columns, but=[text_col]),
        f"IF(is_injection, {text_col}, NULL) AS blocked_text",
    )
    return _write(kept, path, checkpoint, available_now, "decision")


def moderate_stream(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    text_col: str = "text",
    threshold: float = rules.INJECTION_THRESHOLD,
    available_now: bool = False,
) -> StreamingQuery:
    """Chat messages with status and action, by action."""
    return _write(moderate_chat(messages, text_col, threshold), path, checkpoint, available_now, "action")
