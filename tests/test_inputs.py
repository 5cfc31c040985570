"""Tables shared between queries follow the input files; small chunks change no result."""

import math
import shutil

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from odolake.operators import tracks
from odolake.operators.chunks import CHUNK
from odolake.operators.quantiles import Stat, exact_quantiles
from odolake.plans.inputs import Inputs

FOLDER = "/root/testdata/sf0.001"


def test_shared_tables_follow_the_files(spark, tmp_path):
    shutil.copy(f"{FOLDER}/events.parquet", tmp_path / "events.parquet")
    before = Inputs(spark, str(tmp_path)).segments()
    assert Inputs(spark, str(tmp_path)).segments() is before
    half = pq.read_table(f"{FOLDER}/events.parquet")
    (tmp_path / "events.parquet").chmod(0o644)
    pq.write_table(half.filter(pc.equal(pc.bit_wise_and(half["event_id"], 1), 0)), tmp_path / "events.parquet")
    after = Inputs(spark, str(tmp_path)).segments()
    assert after.count() < before.count()


def test_small_chunks_change_no_step(spark):
    i = Inputs(spark, FOLDER)
    small = tracks.segments(i.tracks(), rows=5)
    assert small.select("run_id", "algorithm", CHUNK).distinct().count() > 10 * small.select("algorithm").distinct().count() / 2
    key = ["algorithm", "timestamp_s"]
    want = {tuple(r[c] for c in key): r for r in tracks.steps(i.segments()).collect()}
    mine = {tuple(r[c] for c in key): r for r in tracks.steps(small).collect()}
    assert mine.keys() == want.keys()
    for k, r in mine.items():
        assert r["position_step_m"] == pytest.approx(want[k]["position_step_m"])


def test_crowded_values_are_narrowed_again(spark):
    # Nearly all values lie within 1e-7 of each other, with a far one in the same magnitude class.
    values = [9.81 + k * 1e-10 for k in range(1001)] + [8.1, 15.9] + [9.81] * 500
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    r = exact_quantiles(df, ["k"], "v", [Stat("med"), Stat("p95", 0.95)], ranked_at_once=3).first()
    s = sorted(values)

    def plain(q):
        at = q * (len(s) - 1)
        lo, hi = s[math.floor(at)], s[math.ceil(at)]
        return lo + (at - math.floor(at)) * (hi - lo)

    assert (r["n"], r["med"], r["p95"]) == (len(s), pytest.approx(plain(0.5), abs=0), pytest.approx(plain(0.95), abs=1e-15))
