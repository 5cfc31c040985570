"""Exact top-k inner products by aggregation without random access.

Each block of vectors keeps one list per dimension, sorted by component. A query
reads its lists in order from the end where its weight makes products large, STEP
entries of each at a time. An entry adds its product to its row; a row's unseen
products lie between the least of their list and the last one read from it. Rows
whose upper bound is below the k-th best lower bound drop out, and a query stops
reading once no outsider can qualify. Only the scores of the rows it is left with
are resolved then. The queries of a block read side by side: which entries a step
brings depends on the weight's sign only, so a step adds to the sums of all queries
that still read by one matrix product, and each bound is one more.

Components are turned into integers first, so all bounds and scores are exact.

Cases: see ``vector_blocks``. Fewer candidates than k are all returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import search, usable

K, SCALE = 10, 1024
STEP = 128
"""Entries read from every list between two tests of the bounds."""


def exact_type(x: np.ndarray, q: np.ndarray):
    """double where all sums of bounds stay exact in it, else 64-bit integers."""
    most = 2 * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    return np.float64 if most < 2**53 else np.int64


class SortedLists:
    """The columns of a block, each sorted in ascending order."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.argsort(x, axis=0, kind="stable")

    def candidates(self, q: np.ndarray, k: int, alive: np.ndarray) -> tuple[np.ndarray, int]:
        """queries x rows: which of the rows ``alive`` may have one of the k highest scores; how far the lists were read."""
        kind, (n, dim) = exact_type(self.x, q), self.x.shape
        x, column = self.x.astype(kind), np.arange(dim)
        value = np.take_along_axis(x, self.order, 0)
        up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        seen, unseen, alive = np.zeros((len(q), n), kind), np.ones((2 * dim, n), kind), alive.copy()
        reading, depth = np.arange(len(q)), 0
        while depth < n:
            more = alive[reading].sum(1) > k
            if not more.all():
                reading, up, down, seen = reading[more], up[more], down[more], seen[more]
            if not len(reading):
                break
            end = min(depth + STEP, n)
            found = np.zeros((2 * dim, n), kind)
            for rows, list_ in ((self.order[n - end : n - depth], column), (self.order[depth:end], column + dim)):
                found[list_, rows], unseen[list_, rows] = x[rows, column], 0
            seen += np.hstack([up, down]) @ found
            low = seen + np.hstack([up * value[0], down * value[-1]]) @ unseen
            high = seen + np.hstack([up * value[n - end], down * value[end - 1]]) @ unseen
            low[~alive[reading]] = np.iinfo(np.int64).min // 2
            alive[reading] &= high >= np.partition(low, n - k, axis=1)[:, n - k, None]
            depth = end
        return alive, depth


def _worker(k: int):
    def work(ids, vectors, asked, wanted):
        alive, _ = SortedLists(vectors).candidates(wanted, k, ids != asked[:, None])
        found = []
        for m, q in enumerate(wanted):
            rows = np.flatnonzero(alive[m])
            score = vectors[rows] @ q
            best = np.lexsort((rows, -score))[:k]
            found.append((np.full(len(best), m), rows[best], score[best]))
        return tuple(np.concatenate(part) for part in zip(*found))

    return work


def integers(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``usable`` rows with every component as floor(scale * x)."""
    return usable(table, vec_id, vector).withColumn("v", F.expr(f"transform(v, x -> cast(floor({scale} * x) as bigint))"))


def top(table: DataFrame, queries: str, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose ``id`` meets the SQL condition ``queries``."""
    rows = integers(table, vec_id, vector, scale)
    return search(rows, rows.where(queries), _worker(k), k, "long")
