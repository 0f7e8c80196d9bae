"""Byte-pair merges of one tokenizer file, exact at any length, and its pre-tokens."""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import cache
from itertools import islice

import numpy as np
import regex

NONE = 1 << 62
_BITS = 20
_MASK = (1 << _BITS) - 1
#: Texts longer than this are split match by match, not into one list.
LONG_TEXT = 1 << 20
PIECE = 1 << 16
#: Symbols from which merges go through a heap.
LONG_WORD = 96

#: Words of like size are merged side by side up to the last of these sizes.
_WIDTHS = (0, 6, 9, 13, 20, 40)
_FILL = _MASK

#: Fixed patterns of the two tokenizer files.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabulary strings."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Merges:
    """Merge the lowest-ranked pair, leftmost first, until no pair is left.

    Its attributes are plain dicts and lists, which are broadcast.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + self.end] for c in chars]
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            # the right part keeps its word end; a merge drops none in these files
            new = vocab[left + right]
            self.pairs.setdefault(vocab[left] << _BITS | vocab[right], rank << _BITS | new)
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        of = {c: b for b, c in enumerate(chars)}
        self.bytes: dict[int, bytes] = {}
        for token, number in vocab.items():
            bare = token.removesuffix(self.end) if self.end else token
            self.bytes[number] = bytes(of[c] for c in bare)
        self.vocab = {number: token for token, number in vocab.items()}
        for content, number in self.specials.items():
            self.bytes[number] = content.encode()

    @classmethod
    def of(cls, parts: dict) -> "Merges":
        """From the attributes of another one, as they are broadcast."""
        made = cls.__new__(cls)
        made.__dict__.update(parts)
        return made

    def symbols(self, word: bytes) -> list[int]:
        ids = [self.first[b] for b in word]
        if ids:
            ids[-1] = self.last[word[-1]]
        return ids

    def encode(self, word: bytes) -> list[int]:
        ids = self.symbols(word)
        if len(ids) > LONG_WORD:
            return self._long(ids)
        find = self.pairs.get
        ranks = [find(a << _BITS | b, NONE) for a, b in zip(ids, islice(ids, 1, None))]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = new = best & _MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find(ids[i - 1] << _BITS | new, NONE)
            if i < len(ranks):
                ranks[i] = find(new << _BITS | ids[i + 1], NONE)
        return ids

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers: many words are merged side by side.

        Words of like size lie in the rows of one table, filled up with a symbol
        that merges with nothing.  In each step every row merges its best pair
        and so loses one symbol; rows without a pair are done.
        """
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in zip(_WIDTHS, _WIDTHS[1:]):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                for i, data in self._side_by_side(rows, [words[i] for i in rows.tolist()], sizes[rows]):
                    out[i] = data
        for i in np.flatnonzero(sizes > _WIDTHS[-1]).tolist():
            out[i] = np.array(self.encode(words[i]), "<u4").tobytes()
        return out

    def _tables(self) -> tuple:
        """Sorted pairs with their ranks and results, and the symbols of bytes, as arrays."""
        if not hasattr(self, "tables"):
            keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
            values = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
            order = np.argsort(keys)
            self.tables = keys[order], values[order], np.array(self.first, np.int64), np.array(self.last, np.int64)
        return self.tables

    def _side_by_side(self, rows: np.ndarray, words: list[bytes], sizes: np.ndarray):
        keys, values, first, last = self._tables()

        def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            wanted = left << _BITS | right
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], NONE)

        width = int(sizes.max())
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], first[letters], _FILL)
        end = np.arange(len(words)), sizes - 1
        ids[end] = last[letters[end]]
        ranks = ranked(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.min(axis=1) if ranks.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                packed = ids[done].astype("<u4")
                for i, row, n in zip(rows[done].tolist(), packed, sizes[done].tolist()):
                    yield i, row[:n].tobytes()
                live = ~done
                rows, ids, ranks, sizes, best = rows[live], ids[live], ranks[live], sizes[live], best[live]
                if not len(rows):
                    return
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            ids[each, at] = best & _MASK
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            sizes = sizes - 1
            for shift in (-1, 0):
                place = at + shift
                ok = (place >= 0) & (place < ranks.shape[1])
                r, c = each[ok], place[ok]
                ranks[r, c] = ranked(ids[r, c], ids[r, c + 1])

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n steps."""
        n = len(ids)
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        find = self.pairs.get
        heap = []
        for i in range(n - 1):
            found = find(ids[i] << _BITS | ids[i + 1])
            if found is not None:
                heap.append((found >> _BITS, i, ids[i], ids[i + 1], found & _MASK))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                found = find(new << _BITS | ids[k])
                if found is not None:
                    heapq.heappush(heap, (found >> _BITS, i, new, ids[k], found & _MASK))
            h = before[i]
            if h >= 0:
                found = find(ids[h] << _BITS | new)
                if found is not None:
                    heapq.heappush(heap, (found >> _BITS, h, ids[h], new, found & _MASK))
        return [i for i in ids if i >= 0]


@cache
def newer_letters() -> str:
    """Ranges, for a character class, of letters and digits that the pattern module knows and
    Python's tables do not.  It walks all code points: once, on the driver."""
    known = regex.compile(r"[\p{L}\p{N}]")
    newer = [
        c for c in range(0x110000)
        if not 0xD800 <= c <= 0xDFFF
        and unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))
    ]
    runs: list[list[int]] = []
    for c in newer:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


class PreTokens:
    """Pre-tokens of a text, as the tokenizer file's pattern gives them.

    The pattern module knows letters of newer Unicode versions than the
    tokenizers library.  Such characters are rare; a text that holds one is
    matched on a copy in which a symbol stands in their place.
    """

    def __init__(self, pattern: str, newer: str | None = None):
        self.pattern = regex.compile(pattern)
        if newer is None:
            newer = newer_letters()
        self.newer = regex.compile(f"[{newer}]") if newer else None
        self.lowest = min(newer.replace("-", "")) if newer else chr(0x10FFFF)

    def pieces(self, text: str):
        """Lists of pre-tokens, of bounded length each."""
        if not text.isascii() and max(text) >= self.lowest and self.newer and self.newer.search(text):
            shadow = self.newer.sub("☃", text)
            found = (text[m.start():m.end()] for m in self.pattern.finditer(shadow))
        elif len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        else:
            found = (m[0] for m in self.pattern.finditer(text))
        while piece := list(islice(found, PIECE)):
            yield piece


def split_specials(text: str, specials: dict[str, int]):
    """(text, None) and (None, id) parts in order; the leftmost, longest special wins."""
    if not any(s in text for s in specials):
        yield text, None
        return
    found = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)))
    at = 0
    for m in found.finditer(text):
        if m.start() > at:
            yield text[at:m.start()], None
        yield None, specials[m[0]]
        at = m.end()
    if at < len(text):
        yield text[at:], None


class Memo(dict):
    """Answers for words seen in this worker, emptied when full: speed only."""

    SIZE = 120_000

    def full(self, wanted: int) -> bool:
        return bool(self) and len(self) + wanted > self.SIZE
