"""Toxicity: a learned lexicon, misspellings by automaton, and scores of context windows.

The lexicon has words and word beginnings that stand out in toxic texts of the
labelled rows.  It is kept as a trie.  A word that is not in it is run as a
Levenshtein automaton (one edit: a letter more, less, other, or two swapped)
through the trie, so that misspelled terms are caught.  Hits are weighed by
windows of words; those between quotation marks of their line, however long it
is, or a few words behind a word of reporting are summed apart from the others.
A logistic model joins the sums.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.llm.common import cut, join_small

WINDOW = 50
#: Labelled rows of each class that the model is fitted on, at most.
MAX_TOXIC, MAX_CLEAN = 8_000, 16_000
MAX_TERMS = 2_000
STEMS = range(3, 7)
#: Shortest term that is matched with an edit, and its least weight.
FUZZY_FROM, TELLING = 5, 3.5
FEATURES = 6
#: Letters of a term at least, and words in front of a hit that may report it.
LEAST_LETTERS, REPORTED = 3, 6
_PIECE = 1 << 20
#: Words whose weights a worker keeps, and letters of a word that is kept: speed only.
_MEMO, _MEMO_LETTERS = 300_000, 64
_TOKEN = re.compile(r"[\w@$]+")
#: Letters written as other signs, and words that report speech.
_LEET = str.maketrans("013457@$", "oieastas")
_REPORT = frozenset(
    "said says saying called calls quote quotes quoted wrote writes word words term "
    "sagte nannte schrieb dit appelle écrit dijo llama escribió".split()
)
_MARK = re.compile("[\"“”„«»‹›\n]")
_SPACE = re.compile(r"\s")


class Trie:
    """Terms as nested dicts; the key "" holds a term's weight."""

    def __init__(self, words: dict[str, float]):
        self.root: dict = {}
        for word, weight in words.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = weight

    def within_one(self, word: str) -> float:
        """The largest weight of a term at most one edit away, or 0."""
        best = 0.0
        n = len(word)
        # states of the automaton: (trie node, letters read, edits made)
        open_states = [(self.root, 0, 0)]
        while open_states:
            node, i, edits = open_states.pop()
            if i == n:
                best = max(best, node.get("", 0.0))
            elif word[i] in node:
                open_states.append((node[word[i]], i + 1, edits))
            if edits:
                continue
            if i < n:
                open_states.append((node, i + 1, 1))
                if i + 1 < n and word[i] != word[i + 1] and word[i + 1] in node:
                    swapped = node[word[i + 1]]
                    if word[i] in swapped:
                        open_states.append((swapped[word[i]], i + 2, 1))
            for c, child in node.items():
                if c:
                    open_states.append((child, i, 1))
                    if i < n and c != word[i]:
                        open_states.append((child, i + 1, 1))
        return best


class Lexicon:
    """``words`` and ``stems`` (word beginnings) with weights; ``fuzzy`` has the weights of
    misspelled forms."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy: dict[str, float]):
        self.words, self.stems = words, stems
        self.trie = Trie(fuzzy)
        self.sizes = sorted({len(s) for s in stems}, reverse=True)
        # one edit leaves one half of a term whole, or swaps the letters where the halves meet
        self.heads = {t[: len(t) // 2] for t in fuzzy}
        self.heads |= {t[: len(t) // 2 - 1] + t[len(t) // 2] for t in fuzzy if len(t) > 1}
        self.tails = {t[len(t) // 2:] for t in fuzzy}
        self.head_sizes = {len(x) for x in self.heads}
        self.tail_sizes = {len(x) for x in self.tails}
        self.lengths = {len(t) + d for t in fuzzy for d in (-1, 0, 1)}
        self.memo: dict[str, float] = {}

    def weight(self, token: str) -> float:
        found = self.memo.get(token)
        if found is None:
            found = self._weight(token)
            if len(token) <= _MEMO_LETTERS:
                if len(self.memo) >= _MEMO:
                    self.memo.clear()
                self.memo[token] = found
        return found

    def _weight(self, token: str) -> float:
        best = self._plain(token)
        if not best and not token.isalpha() and any(c.isalpha() for c in token):
            best = self._plain(token.translate(_LEET))
        return best

    def _plain(self, token: str) -> float:
        if token in self.words:
            return self.words[token]
        for size in self.sizes:
            if len(token) > size and token[:size] in self.stems:
                return self.stems[token[:size]]
        if len(token) in self.lengths and (
            any(token[:k] in self.heads for k in self.head_sizes)
            or any(token[-k:] in self.tails for k in self.tail_sizes)
        ):
            return self.trie.within_one(token)
        return 0.0


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """The text in parts of about a million characters with their places; no word is cut."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.end() if found else len(text)
        yield at, text[at:end]
        at = end


def _quoted(text: str, hits: np.ndarray, reports: np.ndarray) -> np.ndarray:
    """Which hits stand between quotation marks of their line, or behind a word of reporting in it.

    Rows of ``hits`` and ``reports`` are the word's number, start and end.
    """
    marks = [(m.start(), m[0] == "\n") for m in _MARK.finditer(text)]
    places = np.array([p for p, _ in marks], np.int64)
    breaks = np.array([b for _, b in marks], bool)
    lines, quotes = np.append(-1, places[breaks]), places[~breaks]
    number, start, end = hits.T
    line = np.searchsorted(lines, start) - 1
    first = lines[line]
    last = np.append(lines, len(text))[line + 1]
    opened = (np.searchsorted(quotes, start) - np.searchsorted(quotes, first)) % 2 == 1
    closed = np.searchsorted(quotes, end) < np.searchsorted(quotes, last)
    if not len(reports):
        return opened & closed
    before = np.searchsorted(reports[:, 0], number) - 1
    told = reports[np.maximum(before, 0)]
    reported = (before >= 0) & (told[:, 0] >= number - REPORTED) & (told[:, 1] > first)
    return opened & closed | reported


def features(text: str, lexicon: Lexicon) -> list[float]:
    """What the model reads; texts of any length, their words piece by piece."""
    lower = text.lower()
    hits, reports, weights, strong = [], [], [], set()
    n = 0
    for at, piece in _pieces(lower):
        tokens = _TOKEN.findall(piece)
        found = {t: w for t in set(tokens) if (w := lexicon.weight(t))}
        # words of reporting at the end of a piece may stand before a hit of the next one
        if found or not _REPORT.isdisjoint(tokens[-REPORTED:]):
            for i, m in enumerate(_TOKEN.finditer(piece), n):
                w = found.get(m[0])
                if w:
                    hits.append((i, at + m.start(), at + m.end()))
                    weights.append(w)
                    if w > 3:
                        strong.add(m[0])
                if m[0] in _REPORT:
                    reports.append((i, at + m.start(), at + m.end()))
        n += len(tokens)
    if not hits:
        return [0.0, 0.0, 0.0, 0.0, 0.0, math.log1p(n)]
    places, w = np.array(hits, np.int64), np.array(weights)
    at, q = places[:, 0], _quoted(lower, places, np.array(reports, np.int64))
    plain = np.where(q, 0.0, w)
    sums = np.concatenate([[0.0], np.cumsum(plain)])
    first = np.searchsorted(at, at - WINDOW, side="right")
    best = float((sums[1:] - sums[first]).max())
    total = float(plain.sum())
    return [
        math.log1p(best), math.log1p(total), math.log1p(100 * total / max(n, 20)),
        math.log1p(len(strong)), math.log1p(float(w[q].sum())), math.log1p(n),
    ]


class Model:
    """A logistic model over standardised features."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    @staticmethod
    def _design(x: np.ndarray) -> np.ndarray:
        # squares let the share of hits count by text length
        both = [x, x ** 2, x[:, :1] * x[:, 5:6], x[:, 1:2] * x[:, 5:6], x[:, 2:3] * x[:, 5:6]]
        return np.concatenate(both, axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> "Model":
        d = cls._design(x)
        mean, scale = d.mean(axis=0), d.std(axis=0)
        scale[scale < 1e-9] = 1.0
        d = np.concatenate([np.ones((len(d), 1)), (d - mean) / scale], axis=1)
        w = np.zeros(d.shape[1])
        keep = np.full(d.shape[1], penalty)
        keep[0] = 1e-3
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            slope = d.T @ (p - y) + keep * w
            curve = (d * (p * (1 - p))[:, None]).T @ d + np.diag(keep)
            step = np.linalg.solve(curve, slope)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def score(self, x: np.ndarray) -> np.ndarray:
        d = (self._design(x) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + d @ self.weights[1:], -30, 30)))


def held_out(key) -> "F.Column":
    """Rows whose key's checksum is divisible by five are never learnt from; null counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  label: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """At most ``max_toxic`` and ``max_clean`` labelled rows (by a hash of the key), with text."""
    marks = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y"))
    marks = marks.where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    marks = marks.groupBy("k").agg(F.max("y").alias("y"))
    of = lambda y, n: marks.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n)
    chosen = cut(of(1, max_toxic).unionByName(of(0, max_clean)), "toxic-labels")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    return cut(join_small(rows, chosen, ["k"], "inner").select("t", "y"), "toxic-rows")


def learn_terms(rows: DataFrame, max_terms: int = MAX_TERMS) -> tuple[dict, dict, dict]:
    """Words and word beginnings with the log odds of being in a toxic text, and the terms that
    are matched with an edit.

    A beginning may stand for a word in exact matching only: its misspellings do not begin so,
    and are looked for by the word itself.
    """
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return {}, {}, {}
    split = F.regexp_extract_all(F.lower("t"), F.lit(r"(?U)[\w@$]+"), F.lit(0))
    seen = rows.select("y", F.explode(F.array_distinct(split)).alias("term"))
    one = lambda y: F.sum((F.col("y") == y).cast("long"))
    words = cut(
        seen.where(F.length("term") >= LEAST_LETTERS).groupBy("term").agg(one(1).alias("d1"), one(0).alias("d0")),
        "toxic-words",
    )
    stems = words.select(
        F.explode(F.array(*[
            F.when(F.length("term") > k, F.substring("term", 1, k)) for k in STEMS
        ])).alias("term"), "d1", "d0",
    ).where("term IS NOT NULL").groupBy("term").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0"))
    least = max(3, math.ceil(0.004 * n1))
    odds = F.log((F.least("d1", F.lit(n1)) + 0.5) / n1) - F.log((F.col("d0") + 0.5) / n0)
    both = words.withColumn("stem", F.lit(False)).unionByName(stems.withColumn("stem", F.lit(True)))
    ranked = both.where(F.col("d1") >= least).withColumn("w", odds).where("w >= 1.8")
    ranked = ranked.withColumn("gain", F.round(F.col("w") * F.col("d1"), 1))
    apart = ranked.where(f"NOT stem AND w >= {TELLING} AND length(term) >= {FUZZY_FROM}").select("term", "w").collect()
    top = ranked.orderBy(F.desc("gain"), F.desc(F.length("term")), "term", "stem").limit(4 * max_terms).collect()
    chosen_words: dict[str, float] = {}
    chosen_stems: dict[str, float] = {}
    for r in top:
        term, w = r["term"], min(float(r["w"]), 8.0)
        if len(chosen_words) + len(chosen_stems) >= max_terms:
            break
        covered = max((chosen_stems[term[:k]] for k in STEMS if term[:k] in chosen_stems), default=None)
        if covered is not None and w < covered + 1:
            continue
        if r["stem"]:
            longer = any(s.startswith(term) for s in chosen_stems)
            if not longer and term not in chosen_words:
                chosen_stems[term] = w
        else:
            chosen_words[term] = w
    return chosen_words, chosen_stems, _misspelled({r["term"]: min(float(r["w"]), 8.0) for r in apart})


def _misspelled(words: dict[str, float]) -> dict[str, float]:
    """Only telling terms are matched with an edit, at part of their weight."""
    return {w: 0.6 * x for w, x in words.items() if len(w) >= FUZZY_FROM and x >= TELLING and w.isalpha()}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "toxic") -> tuple[tuple, Model | None]:
    """(lexicon parts, model); the model is fitted on the driver, from a few numbers per row of
    the bounded sample.  Without both labels there is no model, and all scores are 0."""
    rows = training_rows(docs, labels, key, text, label)
    parts = words, stems, _ = learn_terms(rows)
    if not words and not stems:
        return parts, None
    found = rows.select(measured(rows.sparkSession, parts)(F.col("t").cast("binary")).alias("x"), "y").collect()
    x = np.array([r["x"] for r in found], float)
    y = np.array([r["y"] for r in found], float)
    return parts, Model.fit(x, y)


def measured(spark: SparkSession, parts: tuple):
    """The features of a text as a function of its bytes."""
    shared = spark.sparkContext.broadcast(parts)

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(*shared.value)
        for batch in batches:
            yield pd.Series([features(b.decode("utf-8", "replace"), lexicon) for b in batch], dtype=object)

    return measure


def with_score(docs: DataFrame, labels: DataFrame, out: str = "score", key: str = "doc_id",
               text: str = "text", label: str = "toxic") -> DataFrame:
    """The table with a column of scores (0 to 1); one of that name gives way.

    Null and empty texts are scored as texts without a hit.  Rows are scored one
    by one, so repeated rows come back repeated.  An empty table gives an empty
    one.  Words and lines may be of any length, and a score does not hang on
    where a long text is cut.  A worker holds one Arrow batch, a million
    characters of one text as words, its hits, reporting words and quotation
    marks, and a memo of bounded size.
    """
    parts, model = fit(docs, labels, key, text, label)
    numbers = None if model is None else (model.mean, model.scale, model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((parts, numbers))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts, numbers = shared.value
        lexicon = Lexicon(*parts)
        for batch in batches:
            if numbers is None or not len(batch):
                yield pd.Series(np.zeros(len(batch)))
                continue
            x = np.array([features(b.decode("utf-8", "replace"), lexicon) for b in batch], float)
            yield pd.Series(Model(*numbers).score(x))

    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.withColumn(out, scored(body))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   label: str = "toxic") -> DataFrame:
    """``key``, held_out, score and predicted of every whole text; see ``with_score``."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text))
    out = with_score(rows, labels, "score", key, text, label)
    return out.select(
        F.col(f"`{key}`"), held_out(F.col(f"`{key}`")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
