"""Near-duplicate embeddings."""

import math

import numpy as np
import pytest

from odolake.llm import embedding_dedup as dedup

SCHEMA = "vec_id long, embedding array<{}>, label int, dim string, tile int, links int, copies int, node string"


def table(spark, given, kind="float"):
    return spark.createDataFrame([(i, v, c, "x", 1, 1, 1, "y") for i, v, c in given], SCHEMA.format(kind))


def plain(given, threshold=0.98, kind=np.float32):
    def usable(i, v, c):
        return i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    x = [np.array(v, kind).astype(float) if usable(i, v, c) else None for i, v, c in given]
    near = [[] for _ in given]
    for a in range(len(given)):
        for b in range(a):
            if x[a] is not None and x[b] is not None and given[a][2] == given[b][2] and len(x[a]) == len(x[b]):
                if x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= threshold:
                    near[a].append(b)
                    near[b].append(a)
    out = []
    for a, (i, _, _) in enumerate(given):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min(given[b][0] for b in seen) if i is not None else None
        out.append((i, len(near[a]), least, None if i is None else i == least))
    return sorted(out, key=repr)


def found(df, **how):
    return sorted((tuple(r) for r in dedup.near_duplicates(df, **how).collect()), key=repr)


def cloud(seed, n, dim, spread, labels=2):
    """Groups of near vectors, some of them chains that cross the threshold step by step."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        if k and rng.random() < 0.7:
            base = np.array(out[rng.integers(len(out))][1])
            v = base + rng.normal(size=dim) * spread * np.linalg.norm(base) / math.sqrt(dim)
        else:
            v = rng.normal(size=dim) * rng.choice([0.01, 1, 100])
        out.append((int(rng.permutation(10 * n)[0]), np.float32(v).tolist(), int(rng.integers(labels))))
    return out


@pytest.mark.parametrize("seed,dim,spread", [(1, 24, 0.12), (2, 3, 0.2), (3, 70, 0.2), (4, 2, 0.05)])
def test_links_and_classes_are_those_of_all_pairs(spark, monkeypatch, seed, dim, spread):
    monkeypatch.setattr(dedup, "BLOCK", 16)
    monkeypatch.setattr(dedup, "PARTNERS", 2)
    monkeypatch.setattr(dedup, "ROWS_PER_PART", 100)
    given = cloud(seed, 260, dim, spread)
    want = plain(given)
    assert found(table(spark, given), tile=32) == want
    assert any(r[1] > 3 for r in want) and any(r[1] == 0 for r in want)


def test_a_large_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 32)
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    given = [(k, np.float32(base).tolist(), 1) for k in range(150)]
    given += [(1000 + k, np.float32(base + rng.normal(size=16) * 0.01).tolist(), 1) for k in range(150)]
    given += [(2000 + k, np.float32(rng.normal(size=16)).tolist(), 1) for k in range(50)]
    assert found(table(spark, given), tile=64) == plain(given)


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 0.0], [1.0, 2.0, 0.1]
    given = [(1, v, 1), (2, w, 1), (3, v, 2), (4, v, None), (None, v, 1), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 2.0], 1)]
    given += [(9, [math.nan, 1.0, 2.0], 1), (10, [math.inf, 1.0, 1.0], 1), (11, [1.0, 2.0], 1), (12, [2.0, 4.0], 1), (2, w, 1), (2, [-1.0, -2.0, 0.0], 1), (13, [1e-30, 2e-30, 0.0], 1), (14, [-0.0, 0.0, 5.0], 3), (15, [0.0, -0.0, 5.0], 3)]
    assert found(table(spark, given)) == plain(given)
    doubles = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [2e200, -1e200], 1)]
    assert found(table(spark, doubles, "double")) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert found(table(spark, [])) == []
    assert found(table(spark, [(1, None, 1)])) == [(1, 0, 1, True)]


def test_the_bound_stops_early():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(512, 64)) * 0.9 ** np.arange(64)
    z = dedup.unit(x)
    side = dedup.Side(z.astype(np.float32), x)
    counters = {}
    rows = np.arange(512)
    i, j = dedup.linked(side, rows, side, rows, 0.98, counters)
    want = z @ z.T >= 0.98
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(want))))
    apart = dedup.Side((-z).astype(np.float32), -x)
    counters = {}
    assert not len(dedup.linked(side, rows[:8], apart, rows[:8], 0.98, counters)[0]) and counters["products"] <= 64 * 16
