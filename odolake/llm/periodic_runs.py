"""Periodic runs of words, by maximal pairs.

A run is a stretch of consecutive words with smallest period q and a length of at
least ``max(LEAST, TIMES * q)`` that no neighbouring word extends keeping q. Its first
and second copy form a pair of equal stretches of words, ``q`` apart, that can be
extended neither to the left nor to the right: a maximal pair. Turned round, a
maximal pair whose words reach at least ``TIMES - 1`` times its distance is a run, and
nothing has to be extended.

The texts of a slice share one suffix order (prefix doubling over word numbers that
no two texts share). The intervals of its longest common prefixes form a tree, which
is walked from the leaves to the root. Every interval keeps the places of its
suffixes in order; the class of a place is the word on its left. Where two children
meet, each place of the smaller list looks for the next place on either side in
the larger one: places of different classes are a maximal pair. The next place is
enough, as a word stretch that occurs nearer than q has a smaller period. Intervals
too short for any run are not walked at all.

Cases: null, empty and blank texts have no words and no run. Any id, null included,
keeps its row; repeated rows are worked on one by one. A text is worked on whole: a
very long one is a slice of its own and takes about 50 bytes of memory a word for
each doubling of its longest repeat. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

LEAST, TIMES = 6, 4
"""Words of a run at least, and copies of its period."""

Run = tuple[int, int, int]
"""start, length, period."""


class SuffixOrder:
    """The order of all suffixes that share four words with another one, and how far neighbours agree."""

    def __init__(self, texts: Sequence[Sequence]):
        numbers: list[int] = []
        self.at = [0]
        for words in texts:
            base, own = len(numbers), {}
            numbers += [own.setdefault(w, base + len(own)) for w in words]
            numbers.append(base + len(words))  # an end that occurs once
            self.at.append(len(numbers))
        self.word = np.array(numbers, np.int64)
        n = self.n = len(numbers)
        two = self._join(self.word, 1)
        four = self._join(two, 2)
        count = np.bincount(four, minlength=1)
        rank = (np.cumsum(count) - count)[four]
        self.levels = [(1, self.word), (2, two), (4, rank)]
        tied = self.tied = np.flatnonzero(count[four] > 1)
        k = 4
        while len(tied):
            rank, tied = self._refine(rank, tied, k, n)
            k *= 2
            self.levels.append((k, rank))
        self.order = self.tied[np.argsort(rank[self.tied])]

    @staticmethod
    def _join(rank: np.ndarray, k: int) -> np.ndarray:
        """Ranks by 2k words from ranks by k words; stretches over an end are unlike all others anyway."""
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - k)] = rank[k:]
        return np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].ravel()

    @staticmethod
    def _refine(rank: np.ndarray, tied: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranks by 2k words, which only part what is tied, and what is tied still."""
        key = rank[tied] * (n + 1) + rank[np.minimum(tied + k, n - 1)]
        sort = np.argsort(key, kind="stable")
        tied, key = tied[sort], key[sort]
        old = rank[tied]
        place = np.arange(len(tied))
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.r_[True, old[1:] != old[:-1]]
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[tied] = old + first - np.maximum.accumulate(np.where(group, place, 0))
        alone = new & np.r_[new[1:], True]
        return rank, tied[~alone]

    def agreement(self) -> np.ndarray:
        """For each place of the order, the words it shares with the one before it."""
        a, b = self.order[:-1], self.order[1:]
        shared = np.zeros(len(a), np.int64)
        for k, rank in reversed(self.levels):
            shared += k * (rank[a + shared] == rank[b + shared])
        return np.r_[0, shared] if len(self.order) else np.zeros(0, np.int64)


def maximal_pairs(order: SuffixOrder, least: int, reach: Callable[[int], int]) -> list[tuple[int, int, int]]:
    """(place, later place, shared words) of pairs no farther apart than ``reach(shared)``.

    Of every place at least the pair with the next place of the other children.
    ``least``: intervals of fewer shared words are left out.
    """
    shared = order.agreement()
    deep = shared >= least
    walked = deep | np.r_[deep[1:], False]
    places, depths = order.order[walked].tolist(), np.where(deep, shared, 0)[walked].tolist()
    left = order.word
    out: list[tuple[int, int, int]] = []

    def meet(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        most = reach(depth)
        for p in b:
            k = bisect_left(a, p)
            if k and p - a[k - 1] <= most and left[a[k - 1] - 1] != left[p - 1]:
                out.append((a[k - 1], p, depth))
            if k < len(a) and a[k] - p <= most and left[a[k] - 1] != left[p - 1]:
                out.append((p, a[k], depth))
        if 16 * len(b) < len(a):
            for p in b:
                insort(a, p)
        else:
            a += b
            a.sort()
        return a

    open_depths: list[int] = []
    open_lists: list[list[int]] = []
    held: list[int] = []
    for place, depth in zip([*places, -1], [*depths, 0]):
        while open_depths and open_depths[-1] > depth:
            held = meet(open_lists.pop(), held, open_depths.pop())
        if depth and open_depths and open_depths[-1] == depth:
            open_lists[-1] = meet(open_lists[-1], held, depth)
        elif depth:
            open_depths.append(depth)
            open_lists.append(held)
        held = [place]
    return out


def _least_shared(least: int, times: int) -> int:
    """What the two ends of a run share at least: length - q words, of at least least - q and (times - 1) q."""
    shared = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    if shared < 4:
        raise ValueError("runs so short are not in the order of suffixes that share four words")
    return shared


def find_runs(texts: Sequence[Sequence], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of every list of words, by start, then period."""
    found: list[list[Run]] = [[] for _ in texts]
    shared_least = _least_shared(least, times)
    order = SuffixOrder(texts)
    if not len(order.tied):
        return found
    best: dict[tuple[int, int], int] = {}
    for p, later, shared in maximal_pairs(order, shared_least, lambda d: d // (times - 1)):
        q = later - p
        if shared + q >= least:
            stretch = p, p + shared + q
            best[stretch] = min(q, best.get(stretch, q))
    starts = np.array(order.at)
    for (p, end), q in best.items():
        doc = int(np.searchsorted(starts, p, "right")) - 1
        found[doc].append((p - order.at[doc], end - p, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2], r[1]))
    return found


def collapse(words: Sequence, runs: Sequence[Run]) -> list:
    """The words without those that a run holds behind its first period."""
    keep, done = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if a > done:
            keep += words[done:a]
        done = max(done, b)
    return keep + list(words[done:])


_RUNS = "array<struct<start:long,length:long,period:long>>"


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs and the collapsed text of every row.

    ``rewrite(id, words)`` may change the words of a text (UTF-8) before it is read.
    """
    _least_shared(least, times)
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch, "text"):
                own = ids.slice(first, len(texts))
                words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
                if rewrite:
                    words = [rewrite(i, w) for i, w in zip(own.to_pylist(), words)]
                runs = find_runs(words, least, times)
                flat = np.array([r for doc in runs for r in doc], np.int64).reshape(-1, 3)
                edge = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                short = pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs)], pa.binary())
                yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(edge, spans), short.cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, runs {_RUNS}, collapsed string")


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail where crc32 of the id as text divides by ten, as the registered query asks."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one and hashes of ``detect``'s result."""
    longest = "array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"
    line = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.withColumn("top", F.expr(longest)).selectExpr(
        "doc_id",
        "cast(size(runs) as bigint) as n_runs",
        "-top.start as start",
        "top.length as length",
        "-top.period as period",
        "1000 * top.length div -top.period as exponent_milli",
        f"sha2({line}, 256) as runs_sha256",
        "sha2(collapsed, 256) as collapsed_sha256",
    )
