"""Long texts in overlapping pieces, for scorers with an input limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from veilwork import schemas
from veilwork.functions import spans
from veilwork.functions.sqltext import BLOCK, blocks, cut_out, let
from veilwork.operators.pii import mask_pii
from veilwork.operators.rows import fresh, quoted, unroll


def chunk_text(
    df: DataFrame, text_col: str = "text", max_chars: int = 1024, overlap: int = 128
) -> DataFrame:
    """One row per piece: its number, its offset in the text and the piece.

    Every character is in some piece, and whatever is no longer than the
    overlap is whole in at least one.  Pieces are cut from blocks of the text,
    never recoded.  Other columns stay; the text goes.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and less than max_chars")
    step = max_chars - overlap
    last = f"greatest(CAST(ceil((length({text_col}) - {max_chars}) / {step}) AS int), 0)"

    end = f"least(i * {step} + {max_chars}, length({text_col}))"
    def piece(cut: str) -> str:
        return f"transform(sequence(0, {last}), i -> named_struct('chunk_start', i * {step}, 'chunk', {cut}))"

    # a text of one block needs no blocks: the cuts are the same
    short = piece(f"substring({text_col}, i * {step} + 1, {max_chars})")
    long = let("bl", blocks(text_col), piece(cut_out("bl", f"i * {step}", end)))
    pieces = f"IF(length({text_col}) <= {BLOCK}, {short}, {long})"
    keep = quoted(df.columns, but=[text_col])
    cut = f"IF({text_col} IS NULL, NULL, {pieces})"
    return unroll(df, cut, "chunk_no", *keep).select(
        *keep, "chunk_no", "e.chunk_start", "e.chunk"
    )


def mask_in_chunks(
    df: DataFrame,
    finder: Callable[[DataFrame], DataFrame],
    key: str,
    text_col: str = "text",
    max_chars: int = 1024,
    overlap: int = 128,
    priority=(),
) -> DataFrame:
    """``mask_pii`` for finders with an input limit.

    ``finder`` adds ``entities`` to a table with a ``chunk`` column.  The key
    identifies a text.  Texts and their spans meet again by the key; the texts
    are shuffled once for it.

    A span that touches a cut inside the text may be a part of something else,
    as the finder did not see what lies behind the cut.  It is left to the piece
    next to it if that one holds the place with what surrounds it.  A span that
    fills the overlap is cut there too, and stays: what the pieces found of it
    is joined.
    """
    sized = df.select(key, text_col, F.length(text_col).alias("_length"))
    pieces = chunk_text(sized, text_col, max_chars, overlap)
    inside = F.expr(
        f"filter(entities, e -> (e.start > 0 OR chunk_start = 0 OR e.end >= {overlap}) AND "
        f"(e.end < length(chunk) OR chunk_start + length(chunk) >= _length OR e.start <= {max_chars - overlap}))"
    )
    at = fresh("_found", df)
    found = finder(pieces).select(key, "chunk_start", inside.alias(at))
    lifted = lift_spans(found, key, at, priority)
    return mask_pii(df.join(lifted, key, "left"), text_col, entities_col=at).drop(at)


def lift_spans(
    chunked: DataFrame, key: str, entities_col: str = "entities", priority=()
) -> DataFrame:
    """Spans of the pieces as spans of the whole text, one row per text.

    Copies from the overlaps fall together, and what a cut made shorter is
    joined with the whole span of the piece next to it.  Only spans travel,
    not text; a group is one text.  ``priority`` lists labels, best first.
    """
    ranks = " ".join(f"WHEN '{label}' THEN {i}" for i, label in enumerate(priority))
    rank = f"CASE coalesce(e.entity_group, e.entity) {ranks} ELSE {len(priority)} END" if ranks else "0"
    lifted = (
        f"transform({entities_col}, e -> named_struct('start', e.start + chunk_start, "
        f"'prio', {rank}, 'end', e.end + chunk_start, "
        "'label', coalesce(e.entity_group, e.entity), 'score', e.score, 'word', e.word))"
    )
    # joins without the text: the word of a joined span is put together from
    # its parts by offset
    grouped = chunked.groupBy(key).agg(
        F.array_sort(
            F.array_distinct(F.flatten(F.collect_list(F.expr(f"CAST({lifted} AS {schemas.SPANS})"))))
        ).alias("_s")
    )
    word = (
        "aggregate(g, named_struct('e', g[0].start, 'w', ''), (a, x) -> named_struct("
        "'e', greatest(a.e, x.end), 'w', IF(x.end > a.e, concat(a.w, substring(x.word, a.e - x.start + 1)), a.w)), "
        "a -> a.w)"
    )
    apart = f"IF(size(_s) > 1 AND {spans.overlaps('_s')}, {let('s', '_s', spans.joined_spans(word))}, _s)"
    return grouped.select(key, F.expr(spans.spans_to_entities(apart)).alias(entities_col))
