"""Approximate nearest neighbours by a permutation index.

A vector is represented by the pivots nearest to it, in order. Within a block of
vectors every pivot has an inverted file: the vectors that hold it among their
PREFIX nearest, with its place there. A query walks the files of its own PREFIX
nearest pivots and adds up, for each vector it meets, how far apart the two
places are (the footrule distance; a pivot absent from a prefix counts as placed
at its end). The SHARE of a block with the least footrule, and all that tie with
its last, is reranked by cosine in double precision.

Pivots are the first PIVOTS different vectors among the SPARE times as many usable
ones with the smallest hash of their id: a sample of fixed size. Every vector is indexed. SHARE is a share of the block, so recall
does not fall as the table grows.

Cases: see ``vector_blocks``; zero vectors take no part either. Fewer vectors than
pivots make a shorter permutation; fewer candidates than k are all returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import search, usable

PIVOTS, PREFIX, SHARE, LEAST = 512, 128, 0.10, 32
"""LEAST: candidates reranked per block and query at least."""
SPARE = 4
"""Rows looked at for each pivot, as equal vectors make one pivot."""


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row, nearest first."""
    near = x @ pivots.T
    if prefix < near.shape[1]:
        top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
        inner = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        return np.take_along_axis(top, inner, 1)
    return np.argsort(-near, axis=1, kind="stable")


class InvertedFiles:
    """For each pivot the rows that hold it in their prefix, and its place there."""

    def __init__(self, perm: np.ndarray, pivots: int):
        n, self.prefix = perm.shape
        order = np.argsort(perm.ravel(), kind="stable")
        self.row, self.place = order // self.prefix, order % self.prefix
        self.at = np.searchsorted(perm.ravel()[order], np.arange(pivots + 1))
        self.rows = n

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Distance of the query's permutation to each row's."""
        spans = [slice(self.at[p], self.at[p + 1]) for p in perm]
        rows = np.concatenate([self.row[s] for s in spans])
        places = np.concatenate([self.place[s] for s in spans])
        mine = np.repeat(np.arange(len(perm)), [s.stop - s.start for s in spans])
        saved = (self.prefix - mine) + (self.prefix - places) - np.abs(mine - places)
        return -np.bincount(rows, saved, minlength=self.rows)


def _worker(pivots: np.ndarray, prefix: int, share: float, least: int, k: int):
    def work(ids, vectors, asked, wanted):
        x, q = unit(vectors), unit(wanted)
        own, same = np.unique(x, axis=0, return_inverse=True)  # a product may round equal rows apart
        files = InvertedFiles(permutations(own, pivots, prefix)[same.ravel()], len(pivots))
        most = min(len(ids), max(least, k + 1, int(np.ceil(share * len(ids)))))
        out_q, out_v, out_s = [], [], []
        for n, perm in enumerate(permutations(q, pivots, prefix)):
            far = files.footrule(perm)
            near = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1])
            near = near[ids[near] != asked[n]]
            cosine = (x[near] * q[n]).sum(1)  # the same for equal rows of all blocks
            best = np.lexsort((ids[near], -cosine))[:k]
            out_q.append(np.full(len(best), n))
            out_v.append(near[best])
            out_s.append(cosine[best])
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)

    return work


def nearest(table: DataFrame, queries: str, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) for the rows whose ``id`` meets the SQL condition ``queries``."""
    rows = usable(table, vec_id, vector).where("exists(v, x -> x <> 0)")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SPARE * pivots).collect()
    dims: dict[int, list] = {}
    for v in list(dict.fromkeys(tuple(r["v"]) for r in sample))[:pivots]:
        dims.setdefault(len(v), []).append(v)
    shared = table.sparkSession.sparkContext.broadcast({d: unit(np.array(v)) for d, v in dims.items()})

    def work(ids, vectors, asked, wanted):
        own = shared.value.get(vectors.shape[1])
        if own is None:  # no pivot of this length: all rows of the block are candidates
            own = unit(vectors[:1])
        return _worker(own, min(prefix, len(own)), share, least, k)(ids, vectors, asked, wanted)

    return search(rows, rows.where(queries), work, k, "double")
