"""Exact top-k search with bounds from segment means and deviations, coarse to fine.

Over a segment of L components, with means m and deviations d (the length of
what is left when the mean is taken out), the inner product of two vectors is
at most ``L * m1 * m2 + d1 * d2``; in other words their squared distance is at
least ``L * (m1 - m2)**2 + (d1 - d2)**2``.  Summed over segments this bounds
the score.  Pairs whose bound lies under the query's k-th best score so far are
dropped, first with one segment, then with more; survivors are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Queries broadcast at once, candidates compared at once, rows that give first thresholds.
BLOCK = 2048
CHUNK = 2048
LEVELS = (1, 4, 16)
_LONG = 2**63 - 1


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and integer components; rows with null or non-finite parts take no part."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.where(v.isNotNull() & finite & F.col(f"`{key}`").isNotNull())
        .select(
            F.col(f"`{key}`").cast("long").alias("id"),
            F.transform(v, lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long")).alias("v"),
        )
    )


def _bounds(rows: np.ndarray, segments: int) -> np.ndarray:
    """Per row sqrt(L) * mean and deviation of each segment; the dot product of two bounds a score."""
    parts = np.array_split(rows.astype(np.float64), min(segments, max(rows.shape[1], 1)), axis=1)
    means = [p.mean(axis=1) if p.shape[1] else np.zeros(len(p)) for p in parts]
    spread = [np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, means)]
    scaled = [m * np.sqrt(p.shape[1]) for p, m in zip(parts, means)]
    return np.stack(scaled + spread, axis=1)


def _exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products row by row; beyond 64 bits the nearest long."""
    if not left.size or not right.size:
        return np.zeros(len(left), np.int64)
    peak = float(np.abs(left.astype(np.float64)).max()) * float(np.abs(right.astype(np.float64)).max())
    if peak * left.shape[1] < 2**53:
        return np.einsum("ij,ij->i", left.astype(np.float64), right.astype(np.float64)).astype(np.int64)
    sums = [sum(a * b for a, b in zip(x, y)) for x, y in zip(left.tolist(), right.tolist())]
    return np.array([max(-_LONG, min(_LONG, s)) for s in sums], np.int64)


class Best:
    """The k best (score, then smaller id) of each query among the rows seen."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.queries, self.k = query_ids, queries, k
        self.floor = np.full(len(query_ids), -np.inf) if floor is None else floor.copy()
        self.bounds = [_bounds(queries, s) for s in LEVELS]
        self.norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        self.found = (np.empty(0, np.int64),) * 3
        self.open: list[tuple] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(ids), CHUNK):
            self._chunk(ids[at:at + CHUNK], rows[at:at + CHUNK])

    def _chunk(self, ids: np.ndarray, rows: np.ndarray) -> None:
        alive = np.arange(len(ids))
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        keep = np.ones((len(self.ids), len(ids)), bool)
        for level, segments in enumerate(LEVELS):
            # rounding of the bound is far below this slack
            slack = 1e-3 + 1e-9 * self.norms[:, None] * norms[alive][None, :]
            bound = self.bounds[level] @ _bounds(rows[alive], segments).T + slack
            # scores end at the largest longs, and so do their bounds
            bound = np.clip(bound, -_LONG, _LONG) * (1 + np.sign(bound) * 1e-9)
            keep = keep & (bound >= self.floor[:, None])
            used = keep.any(axis=0)
            alive, keep = alive[used], keep[:, used]
            if not len(alive):
                return
        keep &= self.ids[:, None] != ids[alive][None, :]
        q, c = np.nonzero(keep)
        for at in range(0, len(q), 1 << 17):
            qs, cs = q[at:at + (1 << 17)], alive[c[at:at + (1 << 17)]]
            score = _exact(self.queries[qs], rows[cs])
            good = score.astype(np.float64) >= self.floor[qs] - 1e-6 * np.abs(self.floor[qs])
            self.open.append((qs[good], ids[cs][good], score[good]))
            self.waiting += int(good.sum())
            if self.waiting > 50 * self.k * max(len(self.ids), 100):
                self.settle()
        self.settle()

    def settle(self) -> None:
        q, i, s = (np.concatenate([p[n] for p in [self.found, *self.open]]) for n in range(3))
        self.open, self.waiting = [], 0
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last].astype(np.float64))
        top = rank < self.k
        self.found = q[top], i[top], s[top]


def _matrices(batch: pa.RecordBatch):
    """(ids, rows) per vector length found in an Arrow batch."""
    column = batch.column(1)
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        of = np.flatnonzero(sizes == size)
        yield int(size), ids[of], flat[offsets[of][:, None] + np.arange(size)[None, :]]


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id",
          vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query.

    Queries are the rows whose id is divisible by ``every``; of rows that share
    such an id the smallest vector asks.  Candidates are all rows but those with
    the query's own id, each repeated row for itself, of the query's length.
    Ties go to the smaller id.  No usable row, no result; other columns are not
    read.  Queries go to the driver and the executors a block at a time
    (``block`` of them on average, by a hash of the id), so neither holds more;
    each block is one pass over the candidates, and a task keeps k rows per query.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    out = None
    for number in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).collect()
        by_size: dict[int, list] = {}
        for r in sorted(mine, key=lambda r: r["id"]):
            by_size.setdefault(len(r["v"]), []).append(r)
        packed = {
            size: (np.array([r["id"] for r in part], np.int64),
                   np.array([r["v"] for r in part], np.int64).reshape(len(part), size))
            for size, part in by_size.items()
        }
        # scores against any rows at all are a lower bound of the k-th best
        first = rows.limit(CHUNK).collect() if packed else []
        floors = {}
        for size, (ids, queries) in packed.items():
            seen = [r for r in first if len(r["v"]) == size]
            best = Best(ids, queries, k)
            if seen:
                best.add(np.array([r["id"] for r in seen], np.int64),
                         np.array([r["v"] for r in seen], np.int64).reshape(len(seen), size))
            floors[size] = best.floor
        shared = spark.sparkContext.broadcast((packed, floors))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            packed, floors = shared.value
            best = {size: Best(*packed[size], k, floors[size]) for size in packed}
            for batch in batches:
                for size, ids, found in _matrices(batch):
                    if size in best:
                        best[size].add(ids, found)
            for one in best.values():
                q, i, s = one.found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.ids[q]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"]
                )

        part = rows.mapInArrow(search, "query_id long, vec_id long, score long")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
