"""Chunked windows, exact quantiles and as-of lookups against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from odolake.operators.asof import bracket, covering, nearest
from odolake.operators.chunks import neighbour, running, with_chunk
from odolake.operators.quantiles import Stat, column_quantiles, exact_quantiles, robust_thresholds


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; stamps come in bursts."""
    rng = np.random.default_rng(7)
    key = np.where(rng.random(900) < 0.7, "hot", rng.choice(["a", "b"], 900))
    t = np.sort(rng.gamma(0.3, 50.0, 900).cumsum())
    value = np.where(rng.random(900) < 0.3, 0.0, rng.normal(0, 5, 900) ** 3)
    return pd.DataFrame({"k": key, "t": t, "v": value})


@pytest.mark.parametrize("rows", [20, 100_000])
def test_neighbour_and_running_do_not_depend_on_chunks(spark, skewed, rows):
    df = with_chunk(spark.createDataFrame(skewed).repartition(7), ["k"], "t", rows=rows)
    out = neighbour(df, ["k"], ["t"], ["v"], "p")
    out = neighbour(out, ["k"], ["t"], ["v"], "n", following=True)
    out = running(out, ["k"], ["t"], sums={"total": F.col("v")}, maxima={"top": F.col("v")})
    got = out.select("k", "t", "p.v", "n.v", "total", "top").toDF("k", "t", "p", "n", "s", "m").toPandas()
    got = got.sort_values(["k", "t"]).reset_index(drop=True)
    want = skewed.sort_values(["k", "t"]).reset_index(drop=True)
    g = want.groupby("k")["v"]
    np.testing.assert_allclose(got["p"], g.shift(1), equal_nan=True)
    np.testing.assert_allclose(got["n"], g.shift(-1), equal_nan=True)
    np.testing.assert_allclose(got["s"], g.cumsum(), rtol=1e-9)
    np.testing.assert_allclose(got["m"], g.cummax())
    assert rows > 1000 or df.select("k", "chunk").distinct().count() > 10


@pytest.mark.parametrize("at_once", [0, 10_000])
def test_quantiles_equal_numpy(spark, skewed, at_once):
    rows = pd.concat([skewed, pd.DataFrame({"k": ["a"] * 3, "t": 0.0, "v": [np.nan, np.inf, -np.inf]})])
    stats = [Stat("med"), Stat("p95", 0.95), Stat("lo", 0.01), Stat("up", upper=True)]
    got = exact_quantiles(spark.createDataFrame(rows), ["k"], "v", stats, ranked_at_once=at_once).toPandas()
    for row in got.itertuples():
        v = np.sort(skewed.loc[skewed.k == row.k, "v"].to_numpy())
        assert row.n == len(v)
        np.testing.assert_allclose([row.med, row.p95, row.lo], np.percentile(v, [50, 95, 1]), atol=1e-9)
        assert row.up == v[len(v) // 2]


def test_quantiles_far_from_zero_and_weighted(spark):
    v = 1e6 + np.random.default_rng(1).random(400)
    df = spark.createDataFrame(pd.DataFrame({"k": "x", "v": v, "w": [1, 3] * 200}))
    got = exact_quantiles(df, ["k"], "v", [Stat("p", 0.3)], weight="w", ranked_at_once=0).first()
    assert got["p"] == pytest.approx(np.percentile(np.repeat(v, [1, 3] * 200), 30), abs=1e-9)
    both = column_quantiles(df, ["k"], {"v": [Stat("a", 0.3)], "w": [Stat("b", 0.9)]}).first()
    assert both["a"] == pytest.approx(np.percentile(v, 30), abs=1e-9)
    assert both["b"] == np.percentile([1, 3] * 200, 90)


def test_threshold_floor(spark):
    df = spark.createDataFrame([("a", 0, x) for x in (0.01, 0.02, 0.01, 0.02)], "k string, chunk bigint, v double")
    empty = spark.createDataFrame([("b", 0, float("nan"))], df.schema)
    got = robust_thresholds(df.union(empty), ["k"], {"v": ("limit", 0.5)}).toPandas()
    assert dict(zip(got.k, got.limit)) == {"a": 0.5, "b": 0.5}


def _brute_nearest(samples, q, tie, max_age):
    times = [s[0] for s in samples]
    at = int(np.searchsorted(times, q, side="left"))
    ahead = samples[at] if at < len(samples) else None
    back = samples[at - 1] if at > 0 else None
    if ahead is None or back is None:
        hit = ahead or back
    else:
        da, db = abs(ahead[0] - q), abs(back[0] - q)
        hit = ahead if (da <= db if tie == "later" else da < db) else back
    if max_age is not None and abs(hit[0] - q) > max_age + 1e-12:
        return None
    return hit[1]


@pytest.mark.parametrize("tie", ["later", "earlier"])
@pytest.mark.parametrize("rows", [8, 100_000])
def test_nearest_tie_rules(spark, tie, rows):
    rng = np.random.default_rng(3)
    # Small integers give many exact hits, midpoints and repeated sample times.
    samples = sorted((float(t), i) for i, t in enumerate(rng.integers(0, 60, 60)))
    samples = [(t, i) for i, (t, _) in enumerate(samples)]
    queries = [(j, float(t)) for j, t in enumerate(rng.integers(-4, 140, 150) / 2)]
    q = spark.createDataFrame([("r", *x) for x in queries], "k string, j int, t double")
    s = spark.createDataFrame([("r", *x) for x in samples], "k string, st double, id int")
    for max_age in (None, 1.0):
        out = nearest(q, s, ["k"], t="t", sample_t="st", order=["id"], payload=["id"], tie=tie, max_age=max_age, rows=rows)
        got = {r["j"]: r["id"] for r in out.select("j", "hit.id").collect()}
        want = {j: _brute_nearest(samples, t, tie, max_age) for j, t in queries}
        # Without the later tie the reference also takes the last of equal earlier times.
        assert got == want


def test_covering_last_interval_is_closed(spark):
    s = spark.createDataFrame([("r", x) for x in (0.5, 1.0, 1.5, 2.0, 2.5)], "k string, t double")
    i = spark.createDataFrame([("r", "a", 0.0, 1.0, False), ("r", "b", 1.0, 2.0, True)], "k string, id string, s double, e double, last boolean")
    out = covering(s, i, ["k"], t="t", start="s", end="e", payload=["id", "last"], closed=F.col("cover.last"))
    assert {r["t"]: r["id"] for r in out.select("t", "cover.id").collect()} == {0.5: "a", 1.0: "b", 1.5: "b", 2.0: "b", 2.5: None}


def test_chunks_are_even_whatever_the_stamps_are(spark):
    """A burst, one far stamp and many equal stamps in a track: no chunk is much larger than asked for."""
    rows = [("a", k * 1e-6, k) for k in range(1500)] + [("a", 1.7e9, 1500)] + [("a", 5.0, 2000 + k) for k in range(1500)]
    rows += [("b", 1e3 * k, k) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, t double, n long").repartition(5)
    cut = with_chunk(df, ["k"], "t", "n", rows=100)
    size = [r["count"] for r in cut.groupBy("chunk").count().collect()]
    assert len(size) > 20 and max(size) <= 3 * 100
    ends = {}
    for r in cut.groupBy("k", "chunk").agg(F.min(F.struct("t", "n")).alias("lo"), F.max(F.struct("t", "n")).alias("hi")).orderBy("k", "chunk").collect():
        assert r["k"] not in ends or ends[r["k"]] < tuple(r["lo"])
        ends[r["k"]] = tuple(r["hi"])


def test_lookup_of_a_query_without_a_time(spark):
    q = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0)], "k string, id int, t double")
    s = spark.createDataFrame([("a", 1.0), ("a", 9.0)], "k string, s double")
    for rows in (1, 1000):
        got = {r["id"]: (r["before"], r["after"]) for r in bracket(q, s, ["k"], t="t", sample_t="s", payload=["s"], rows=rows).collect()}
        assert got[1] == (None, None) and (got[2][0]["t"], got[2][1]["t"]) == (1.0, 9.0)
