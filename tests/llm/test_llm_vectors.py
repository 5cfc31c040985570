"""Permutation index and exact top-k against brute force."""

import math

import numpy as np
import pytest

from odolake.llm import nra_topk, permutation_index

TABLE = "/root/testdata/sf0.001/embeddings.parquet"


def vectors(spark, given):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in given], "vec_id long, embedding array<float>, id int, dim string")


def usable(v, zero=True):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


ODD = [(1000, None), (1050, []), (1100, [1.0, None, 2.0]), (1150, [float("nan"), 1.0, 1.0]), (1200, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (1250, [0.0, 0.0, 0.0])]


def test_recall_of_the_whole_table(spark):
    table = spark.read.parquet(TABLE)
    raw = table.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in raw], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in raw])
    found = {}
    for r in permutation_index.nearest(table, "id % 50 = 0").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = x @ x[q]
        cosine[q] = -9
        mine = sorted(found[ids[q]])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(m[2] == pytest.approx(cosine[ids == m[1]][0], abs=1e-12) for m in mine)
        assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        hit += len({m[1] for m in mine} & set(ids[np.lexsort((ids, -cosine))[:5]].tolist()))
        total += 5
    assert hit / total >= 0.9


def test_ties_in_a_large_group_of_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    ids = rng.permutation(3000)
    x[::3] = x[0]
    out = permutation_index.nearest(vectors(spark, [(int(i), v.tolist()) for i, v in zip(ids, x.astype(np.float32))]), "id % 50 = 0").collect()
    group = np.sort(ids[::3])
    asked = [int(q) for q in group if q % 50 == 0]
    assert asked
    for q in asked:
        assert [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] == group[group != q][:5].tolist()


def test_small_tables_are_searched_whole(spark):
    given = [(k, [math.cos(k), math.sin(k), 0.5]) for k in range(0, 30)] + [(60 + k, [1.0, 0.0, 0.5]) for k in range(3)] + ODD
    out = permutation_index.nearest(vectors(spark, given), "id % 10 = 0").collect()
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in given if i is not None and usable(v, False)]
    for q, u in [(i, v) for i, v in good if i % 10 == 0]:
        want = sorted(((-np.float64(u @ v), i) for i, v in good if i != q))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert [m[2] for m in mine] == [pytest.approx(-s, abs=1e-7) for s, _ in want]
    assert {r.query_id for r in out} == {i for i, _ in good if i % 10 == 0}


def test_few_and_no_vectors(spark):
    assert permutation_index.nearest(vectors(spark, []), "id % 50 = 0").collect() == []
    assert permutation_index.nearest(vectors(spark, [(0, [1.0, 2.0])]), "id % 50 = 0").collect() == []
    out = permutation_index.nearest(vectors(spark, [(0, [1.0, 2.0]), (50, [2.0, 4.0]), (7, [1.0])]), "id % 50 = 0").collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in out) == [(0, 1, 50), (50, 1, 0)]


def plain_top(given, k, own):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in given if i is not None and usable(v)]
    out = set()
    for q, u in {i: v for i, v in good if own(i)}.items():
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in good if i != q and len(v) == len(u))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def test_top_scores_are_exact(spark):
    rng = np.random.default_rng(4)
    given = [(k, [float(x) for x in rng.choice([-1.5, -0.25, 0.0, 0.25, 1.0], 3)]) for k in range(220)] + ODD + [(300, [1.0, 2.0]), (301, [2.0, 2.0])]
    out = nra_topk.top(vectors(spark, given), "id % 20 = 0").collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out} == plain_top(given, 10, lambda i: i % 20 == 0)
    assert nra_topk.top(vectors(spark, []), "id % 20 = 0").collect() == []


def test_top_of_the_whole_table(spark):
    table = spark.read.parquet(TABLE)
    given = [(r.vec_id, r.embedding) for r in table.collect()]
    out = nra_topk.top(table, "id % 100 = 0").collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out} == plain_top(given, 10, lambda i: i % 100 == 0)


@pytest.mark.parametrize("seed", range(40))
def test_bounds_lose_no_candidate(seed):
    rng = np.random.default_rng(seed)
    n, dim, k = int(rng.integers(1, 400)), int(rng.integers(1, 6)), int(rng.integers(1, 12))
    x = rng.integers(-3, 4, (n, dim)) * (10**8 if seed % 3 == 0 else 1)
    q = np.vstack([x[rng.integers(0, n, 4)], np.zeros((1, dim), np.int64)])
    allowed = rng.random((5, n)) < 0.9
    left, _ = nra_topk.SortedLists(x).candidates(q, k, allowed)
    score = q @ x.T
    assert (allowed | ~left).all()
    for m in range(5):
        mine = np.sort(score[m, allowed[m]])
        if len(mine):
            assert left[m, allowed[m] & (score[m] >= mine[-min(k, len(mine))])].all()


def test_lists_are_read_no_farther_than_needed():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 100, (2000, 4))
    x[:20] += 1000
    left, depth = nra_topk.SortedLists(x).candidates(np.array([[3, 2, 5, 1], [1, 0, 2, 3]]), 10, np.ones((2, 2000), bool))
    assert all(set(np.flatnonzero(mine)) <= set(range(20)) for mine in left) and depth <= 2 * nra_topk.STEP


def test_repeated_ids_are_rows_of_their_own(spark):
    given = [(k % 7, [float(k), 1.0]) for k in range(40)]
    out = nra_topk.top(vectors(spark, given), "id = 3").collect()
    asked = {r.query_id for r in out}
    assert asked == {3} and len(out) == 10 and all(r.vec_id != 3 for r in out)
