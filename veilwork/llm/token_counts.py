"""Token counts by the whole-token shortcut.

Before any text is read, each vocabulary string is put through the merges; those
that come out as themselves are proven to be one token when they stand alone.
A pre-token among them counts 1 without a merge; only the rest is merged.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from veilwork.llm.merges import WORD_PATTERN, Memo, Merges, PreTokens, split_specials


#: Lower case of capitals that this Python's Unicode tables lack and the
#: tokenizers library knows; first capital, last capital, first small letter.
_NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD),
    (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70),
    (0x16EA0, 0x16EB8, 0x16EBB),
)
_LOWER = {ord("Σ"): "σ"} | {
    c: small + c - first for first, last, small in _NEWER_CAPITALS for c in range(first, last + 1)
}
_SPECIAL_CASE = regex.compile("[" + "".join(map(chr, _LOWER)) + "]")


def whole_tokens(merges: Merges) -> frozenset[str]:
    """Words (as text) whose merges are proven to end in one token."""
    found = set()
    for number, token in merges.vocab.items():
        if merges.end and not token.endswith(merges.end):
            continue
        word = merges.bytes[number]
        if merges.encode(word) != [number]:
            continue
        try:
            found.add(word.decode("utf-8"))
        except UnicodeDecodeError:
            continue
    return frozenset(found)


def normal(text: str) -> str:
    """NFC, then each character's lower case by itself (no rule for a final sigma)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if max(text) >= "Σ" and _SPECIAL_CASE.search(text):
        text = text.translate(_LOWER)
    return text.lower()


class Counter:
    def __init__(self, merges: Merges, whole: frozenset[str]):
        self.merges, self.whole = merges, whole
        self.pre = PreTokens(WORD_PATTERN)
        self.memo = Memo()

    def count(self, text: str) -> int:
        total, memo, whole = 0, self.memo, self.whole
        for part, special in split_specials(text, self.merges.specials):
            if part is None:
                total += 1
                continue
            for tokens in self.pre.pieces(normal(part)):
                rest = [t for t in tokens if t not in whole]
                total += len(tokens) - len(rest)
                new = [t for t in set(rest) if t not in memo]
                if memo.full(len(new)):
                    memo.clear()
                    new = list(set(rest))
                for t in new:
                    memo[t] = len(self.merges.encode(t.encode("utf-8")))
                total += sum(map(memo.__getitem__, rest))
        return total


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes (UTF-8) and n_tokens of every whole text.

    Null and empty texts have 0 bytes and tokens.  Rows are counted one by one,
    so repeated rows come back repeated; an empty table gives an empty one;
    other columns are not read.  ``path`` is read on the driver, and the merges
    (as large as the vocabulary, whatever the table) are broadcast.  A worker
    holds one Arrow batch, one text's pre-tokens in pieces and a memo of at
    most ``Memo.SIZE`` words.
    """
    merges = Merges(path)
    shared = docs.sparkSession.sparkContext.broadcast((vars(merges), whole_tokens(merges)))

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts, whole = shared.value
        counter = Counter(Merges.of(parts), whole)
        for batch in batches:
            yield pd.Series([counter.count(b.decode("utf-8", "replace")) for b in batch], dtype="int64")

    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(
        F.col(f"`{key}`").alias(key), F.octet_length(body).cast("long").alias("n_bytes"),
        counted(body).alias("n_tokens"),
    )
