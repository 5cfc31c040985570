"""Readers, writers, the SQLite log source and the streaming state functions."""

import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from odolake.operators import logs, resources
from odolake.plans import source_queries
from odolake.plans.inputs import Inputs
from odolake.plans.registry import QUERIES
from odolake.sources import files
from odolake.sources.sqlite_log import MessageLogSource
from odolake.streaming import live


def test_tracks_round_trip(spark, tmp_path):
    head = "timestamp_s,x_m,y_m,z_m,qx,qy,qz,qw,roll_rad,pitch_rad,yaw_rad,source_topic\n"
    (tmp_path / "a.csv").write_text(head + "2,1,0,0,0,0,0,1,,0,0.5,/o\n1,3,0,0,0,0,0,1,0,0,0,/o\n1,4,0,0,0,0,0,1,0,0,0,/o\n")
    df = files.read_tracks(spark, str(tmp_path / "*.csv"), "r")
    rows = df.orderBy("timestamp_s").collect()
    assert [(r["algorithm"], r["timestamp_s"], r["x_m"], r["roll_rad"]) for r in rows] == [("a", 1.0, 3.0, 0.0), ("a", 2.0, 1.0, 0.0)]
    files.write_tum(df, str(tmp_path / "tum"))
    text = spark.read.text(str(tmp_path / "tum")).select("value").collect()
    assert text[0][0].startswith("1.000000000 3.000000000")
    files.write_tracks_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_resources_anchors_status_logs(spark, tmp_path):
    a = tmp_path / "algo"
    a.mkdir()
    sample = {"at": "2024-01-01T00:00:01", "elapsed_s": 1.0, "cpu_percent": 5.0, "rss_bytes": 1048576, "threads": 2}
    (a / "resource.json").write_text(json.dumps({"latest": sample, "status": "live"}))
    got = files.read_resources(spark, str(a / "resource.json"), "r").collect()
    assert [(r["algorithm"], r["cpu_percent"], r["wall_s"]) for r in got] == [("algo", 5.0, 1704067201.0)]
    for name, doc in (("list.json", [{"wall_time_ns": 1, "ros_time_s": 2.0}]), ("wrapped.json", {"anchors": [{"wall_time_ns": 1, "ros_time_s": 2.0}]})):
        (a / name).write_text(json.dumps(doc))
        rows = files.read_anchors(spark, str(a / name), "r").collect()
        assert [(r["wall_time_ns"], r["ros_time_s"]) for r in rows] == [(1, 2.0)]
    status = {"run_id": "r", "algorithms": {"algo": {"state": "done", "result": {"status": "SUCCESS", "output_dir": "x"}}}, "events": [{"at": "t", "algorithm": "algo", "bag_playback": "running"}]}
    (a / "status.json").write_text(json.dumps(status))
    algorithms, events = files.read_run_status(spark, str(a / "status.json"))
    assert algorithms.first()["result_output_dir"] == "x" and events.first()["pos"] == 0
    (a / "node.log").write_bytes(b"fine\n[ERROR] bad \xff\nOut Of Memory\n")
    found = logs.findings(files.read_log_lines(spark, str(a / "node.log"), "r")).orderBy("line").collect()
    assert [(f["line"], f["severity"]) for f in found] == [(2, "HIGH"), (3, "CRITICAL")]


def test_hashes_and_digest(spark, tmp_path):
    for name in ("x.txt", "y.txt"):
        (tmp_path / name).write_text(name)
    rows = files.file_hashes(spark, str(tmp_path), "r")
    assert {r["sha256"] for r in rows.collect()} == {hashlib.sha256(n.encode()).hexdigest() for n in ("x.txt", "y.txt")}
    one = files.tree_digest(rows).first()
    assert one["files"] == 2 and one["digest"] == files.tree_digest(rows.repartition(3)).first()["digest"]


def test_sqlite_log_source(spark, tmp_path):
    path = str(tmp_path / "log.db3")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE topics(id INTEGER, name TEXT, type TEXT)")
    db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    db.executemany("INSERT INTO topics VALUES(?, ?, ?)", [(1, "/lidar", "L"), (2, "/imu", "I")])
    db.executemany("INSERT INTO messages VALUES(?, ?, ?, ?)", [(i, 1 + i % 2, i * 10, b"x") for i in range(1, 101)])
    db.commit()
    db.close()
    spark.dataSource.register(MessageLogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("message_log").option("idsPerPartition", 30).load(path)
    assert df.rdd.getNumPartitions() == 4
    assert df.count() == 100
    assert df.where("topic = '/lidar'").agg(F.count("*"), F.min("message_id")).first()[0:2] == (50, 2)
    with pytest.raises(Exception, match="missing topic"):
        spark.read.format("message_log").load(path).where("topic = '/none'").count()


def test_resource_time_report(spark):
    df = spark.createDataFrame([("\tMaximum resident set size (kbytes): 1234\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.5\n",), ("",)], "text string")
    rows = logs.resource_time(df).select("max_rss_kb", "elapsed_wall").collect()
    assert [tuple(r) for r in rows] == [(1234, "1:02.5"), (None, None)]


def test_stream_equals_batch_across_batches(spark, tmp_path):
    """State carries over micro-batches: two files, one per batch."""
    for part in (0, 1):
        spark.range(part * 50, part * 50 + 50).selectExpr(
            "'r' as run_id", "id * 40000000 as wall_time_ns", "id * 40000000 - if(id = 60, 3000000000, 0) as ros_time_ns", "id as seq"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "clock"))
    stream = spark.readStream.schema("run_id string, wall_time_ns bigint, ros_time_ns bigint, seq bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "clock"))
    got = live.drain(live.throttle_anchors(stream, 0.1), "t").orderBy("sequence").collect()
    assert [r["wall_time_ns"] // 40000000 for r in got] == list(range(0, 100, 3))
    assert got[-1]["ros_backtracks"] == 1 and got[-1]["sequence"] == 33


def test_run_mode_prefers_the_weaker(spark):
    df = spark.createDataFrame([("r", resources.STRICT), ("r", resources.APPROXIMATE), ("q", resources.STRICT)], "run_id string, time_alignment_mode string")
    assert {r[0]: r[1] for r in resources.run_mode(df).collect()} == {"r": resources.APPROXIMATE, "q": resources.STRICT}


def test_digests_by_blocks_are_those_by_hand(spark, tmp_path):
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {"empty": b"", "one": b"x" * 10, "two": bytes(range(11)), "many": bytes(k % 251 for k in range(1007))}
    (tmp_path / "deep folder").mkdir()
    for name, data in texts.items():
        (tmp_path / ("deep folder" if name == "many" else ".") / name).write_bytes(data)

    def by_hand(data, block=10, fanout=3):
        level = [sha(data[k : k + block]) for k in range(0, max(1, len(data)), block)]
        while len(level) > 1:
            level = [sha("".join(level[k : k + fanout]).encode()) for k in range(0, len(level), fanout)]
        return sha(f"{len(data)}:{level[0]}".encode())

    out = files.block_digests(files.list_files(spark, str(tmp_path)), 10, 3).collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["size_bytes"], r["digest"]) for r in out} == {n: (len(d), by_hand(d)) for n, d in texts.items() if d}


def test_broken_logs_and_documents(spark, tmp_path):
    logs, docs = tmp_path / "logs", tmp_path / "docs"
    (logs / "algorithm=a").mkdir(parents=True)
    docs.mkdir()
    (logs / "algorithm=a" / "x.log").write_bytes(b"fine\nbad \xff\xfe end\n\xc3\xa4 ok")
    rows = files.read_log_lines(spark, str(logs), "r", files.FOLDER).orderBy("line").collect()
    assert [(r["line"], r["text"]) for r in rows] == [(1, "fine"), (2, "bad \ufffd\ufffd end"), (3, "\u00e4 ok")]
    given = {"sound": b'{"run_id":"a","n":1}', "cut": b'{"run_id":"a","n":', "list": b"[1]", "empty": b"", "other": b'{"run_id":"b","n":"x"}', "bytes": b'{"run_id":"\xff"}', "null": b"null"}
    for name, data in given.items():
        (docs / f"{name}.json").write_bytes(data)
    sound, rejected = files.read_documents(spark, str(docs), "run_id string, n bigint")
    assert sorted((r["run_id"], r["n"]) for r in sound.collect()) == [("a", 1), ("\ufffd", None)]
    names = sorted(r["path"].rsplit("/", 1)[1].removesuffix(".json") for r in rejected.collect())
    assert [n for n in names if n != "empty"] == ["cut", "list", "null", "other"]


def test_parts_of_one_log_are_numbered_on(spark, tmp_path):
    for name, parts in {"a": ["x\ny\n", "z\n"], "b": ["u\n"]}.items():
        folder = tmp_path / f"algorithm={name}"
        folder.mkdir()
        for k, text in enumerate(parts):
            (folder / f"part-{k:05d}.txt").write_text(text)
    rows = files.read_log_lines(spark, str(tmp_path), "r", files.FOLDER).orderBy("algorithm", "line").collect()
    assert [(r["algorithm"], r["line"], r["text"]) for r in rows] == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "u")]


def _few_events(spark, folder):
    """Events of 80 users and 2 types below ``folder``."""
    rows = [(k, f"2024-01-01 00:00:{k % 60:02d}", k % 80, ("view", "click")[k // 80 % 2], float(k)) for k in range(320)]
    df = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double")
    df.selectExpr("event_id", "cast(t as timestamp) as ts", "user_id", "event_type", "value").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return Inputs(spark, str(folder))


def test_many_documents_need_few_files(spark, tmp_path):
    i = _few_events(spark, tmp_path)
    written = spark.read.text(source_queries._broken_documents(i)).select("_metadata.file_path", "value")
    assert written.count() == 160 and written.select("file_path").distinct().count() < 40
    sound = QUERIES["read_documents"](spark, str(tmp_path)).collect()
    assert {(r["user"], r["type"], r["n"]) for r in sound if r["user"] < 5} == {
        (3, "view�", 2), (3, "click�", 2), (4, "view", None), (4, "click", None)
    }
    assert len(sound) == 64
    rejected = {r["text"] for r in QUERIES["rejected_documents"](spark, str(tmp_path)).collect()}
    assert {'{"user":0,"type":"view","n":', "[1]", '{"user":2,"type":"click","n":"many"}'} <= rejected and len(rejected) == 32 * 2 + 16


def test_one_document_a_line_or_a_file(spark, tmp_path):
    given = [b'{"run_id":"a","n":1}', b'{"run_id":"a","n":', b"[1]", b"", b'{"run_id":"\xff"}']
    (tmp_path / "lines.json").write_bytes(b"\n".join(given) + b"\n")
    sound, rejected = files.read_documents(spark, str(tmp_path), "run_id string, n bigint", lines=True)
    assert sorted((r["run_id"], r["n"]) for r in sound.collect()) == [("a", 1), ("�", None)]
    assert sorted(r["text"] for r in rejected.collect()) == ["", "[1]", '{"run_id":"a","n":']


def test_many_status_documents_need_few_files(spark, tmp_path):
    i = _few_events(spark, tmp_path)
    written = spark.read.text(source_queries._status_files(i)).select("_metadata.file_path", "value")
    assert written.count() == 80 and written.select("file_path").distinct().count() < 40
    rows = QUERIES["read_run_status"](spark, str(tmp_path)).collect()
    got = {(r["run_id"], r["algorithm"]): (r["state"], r["output_dir"], r["status"], r["messages"]) for r in rows}
    assert len(got) == len(rows) == 160
    assert got["run_1", "view"] == ("done", "out/161", "SUCCESS", 2) and got["run_79", "click"] == ("done", "out/319", "SUCCESS", 2)
