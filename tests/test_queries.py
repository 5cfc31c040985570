"""Registered queries beside their SQL at the smallest scale.

A spread of queries runs by default; ODOLAKE_ALL=1 runs every one of them.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = {
    "topic_profile", "standardize_tracks", "anomaly_windows", "timeline_resources", "phase_resource_metrics",
    "symmetric_nn", "log_groups", "stream_topic_rates", "read_tracks", "read_tracks_finite", "read_resources",
    "read_log_lines", "phase_table", "rigid_fit_se3", "rigid_fit_sim3", "stream_jump_windows", "stream_standardize",
    "timeline_window_lists", "first_transforms", "map_items", "relative_error",
}
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and (os.environ.get("ODOLAKE_ALL") or n in SOME)]


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    sql = entry.oracle_sql()[name]
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = sorted(range(len(names)), key=names.__getitem__)
    theirs = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    assert mine == theirs
