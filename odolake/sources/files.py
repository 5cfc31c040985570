"""Readers and writers for the recorded files, all through Spark's own formats."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite
from ..functions.text import iso_seconds
from ..operators.keep import keep
from ..operators.tracks import ANGLES, POSE, TRACK

TRACK_SCHEMA = ", ".join(f"{c} double" for c in [*POSE, *ANGLES]) + ", source_topic string"
SAMPLE = "at string, elapsed_s double, cpu_percent double, rss_bytes bigint, threads int, write_bytes bigint"
ANCHOR = T.StructType(
    [
        T.StructField("wall_time_ns", T.LongType()),
        T.StructField("ros_time_ns", T.LongType()),
        T.StructField("ros_time_s", T.DoubleType()),
        T.StructField("sequence", T.LongType()),
    ]
)


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


STEM = r"([^/]+)\.[^./]+$"
PARENT = r"([^/]+)/[^/]+$"
FOLDER = r"algorithm=([^/]+)/"
"""Where the algorithm's name stands in a path: the file's name, its folder, or a partition folder."""


def _name(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def _place() -> Column:
    """Order of rows within and over files: path, block, row within the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_messages(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """The message table; a topic filter prunes its partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("topic") == topic) if topic else df


def read_tracks(
    spark: SparkSession, path: str, run_id: str, *, drop_non_finite: bool = False, least_stamps: int = 1, name: str = STEM
) -> DataFrame:
    """Trajectory CSVs with missing angles as 0.

    The first row of a stamp wins, in the order of the files' rows. With
    ``drop_non_finite`` a row with a non-finite value in any column drops out
    before that. Tracks of fewer than ``least_stamps`` different stamps drop out.
    """
    schema = _struct(TRACK_SCHEMA)
    df = spark.read.schema(schema).option("header", True).csv(path)
    df = df.select(
        F.lit(run_id).alias("run_id"),
        _name(name).alias("algorithm"),
        _place().alias("place"),
        *POSE,
        *(F.coalesce(F.col(a), F.lit(0.0)).alias(a) for a in ANGLES),
        "source_topic",
    )
    if drop_non_finite:
        df = df.where(finite(*POSE, *ANGLES))
    rest = [c for c in df.columns if c not in (*TRACK, "timestamp_s", "place")]
    rows = (
        df.groupBy(*TRACK, "timestamp_s")
        .agg(F.min_by(F.struct(*rest), "place").alias("r"))
        .select(*TRACK, "timestamp_s", "r.*")
    )
    if least_stamps > 1:
        long = rows.groupBy(*TRACK).agg(F.count("*").alias("stamps")).where(F.col("stamps") >= least_stamps)
        rows = rows.join(long.select(*TRACK), TRACK, "left_semi")
    return rows


def read_resources(spark: SparkSession, path: str, run_id: str, name: str = PARENT) -> DataFrame:
    """Resource records to samples: the history, else the latest sample."""
    item = _struct(SAMPLE)
    schema = T.StructType(
        [
            T.StructField("status", T.StringType()),
            T.StructField("samples", T.LongType()),
            T.StructField("wall_time_s", T.DoubleType()),
            T.StructField("latest", item),
            T.StructField("sample_history", T.ArrayType(item)),
        ]
    )
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = df.select(
        F.lit(run_id).alias("run_id"),
        _name(name).alias("algorithm"),
        F.posexplode(F.expr("coalesce(sample_history, if(latest is null, null, array(latest)))")).alias("seq", "s"),
    ).where("s.elapsed_s is not null")
    return rows.select(*TRACK, F.col("seq").cast("bigint").alias("seq"), "s.*").withColumn(
        "wall_s", iso_seconds(F.col("at"))
    )


def read_anchors(spark: SparkSession, path: str, run_id: str, name: str = PARENT) -> DataFrame:
    """Clock anchors stored as a list or below ``anchors``."""
    text = spark.read.text(path, wholetext=True)
    wrapped = T.StructType([T.StructField("anchors", T.ArrayType(ANCHOR))])
    rows = text.select(
        F.lit(run_id).alias("run_id"),
        _name(name).alias("algorithm"),
        F.coalesce(
            F.from_json("value", wrapped)["anchors"], F.from_json("value", T.ArrayType(ANCHOR))
        ).alias("a"),
    )
    return rows.select(*TRACK, F.explode("a").alias("a")).select(*TRACK, "a.*")


RUN_STATUS = (
    "run_id string, state string, phase string, algorithms map<string, struct<state:string,reason:string,"
    "output_dir:string,result:struct<status:string,output_dir:string,trajectory_messages:bigint,"
    "algorithm_exit_code:int,smoke_duration_s:double,duration_s:double>>>,"
    " events array<struct<at:string,algorithm:string,state:string,bag_playback:string,event:string,reason:string>>"
)


def read_run_status(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Algorithm records and lifecycle events of run status documents: one a file or, with ``lines``, one a line."""
    df = spark.read.schema(_struct(RUN_STATUS)).option("multiLine", not lines).json(path)
    algorithms = df.select("run_id", F.explode("algorithms").alias("algorithm", "e")).select(
        "run_id", "algorithm", "e.state", "e.reason", F.col("e.output_dir").alias("output_dir"),
        F.col("e.result").isNotNull().alias("has_result"), "e.result.status",
        F.col("e.result.output_dir").alias("result_output_dir"),
        F.col("e.result.trajectory_messages").alias("messages"),
        F.col("e.result.algorithm_exit_code").alias("exit_code"),
        "e.result.smoke_duration_s", F.col("e.result.duration_s").alias("limit_s"),
    )
    events = df.select("run_id", F.posexplode("events").alias("pos", "e")).select("run_id", "pos", "e.*")
    return algorithms, events


def read_documents(spark: SparkSession, path: str, ddl: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(path and the fields of every sound JSON document, path and text of the others).

    A file is a document; with ``lines`` every line is one, so that many small
    documents need few files. Bytes that are no UTF-8 become replacement characters
    first. A document is rejected as a whole if it is cut off, is no object or has a
    field of another kind.
    """
    whole = T.StructType([*_struct(ddl).fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.text(path, wholetext=not lines).select(
        F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("text")
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    rows = rows.withColumn("d", F.from_json("text", whole, options))
    sound = "d is not null and d._broken is null and startswith(ltrim(text), '{')"
    return rows.where(sound).select("path", "d.*").drop("_broken"), rows.where(f"not ({sound})").select("path", "text")


def topic_inventory(metadata: DataFrame) -> DataFrame:
    """Topics of parsed log metadata (``topics array<struct<name,type,count>>``)."""
    return metadata.selectExpr("run_id", "posexplode(topics) as (pos, t)").selectExpr(
        "run_id", "pos", "t.name as topic", "t.type as type", "t.count as messages"
    )


def read_log_lines(spark: SparkSession, path: str, run_id: str, name: str = PARENT) -> DataFrame:
    """Numbered lines of text logs, read by block; bytes that are no UTF-8 become replacement characters.

    A line's number is its place in its block plus the lines of the blocks ahead,
    which come from one small row per block; no task holds a whole file. The files of
    one ``FOLDER`` are parts of one log in the order of their paths, others are logs
    of their own.
    """
    place = _place()
    rows = spark.read.text(path).select(
        F.lit(run_id).alias("run_id"),
        _name(name).alias("algorithm"),
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source"),
        place.alias("place"),
        F.make_valid_utf8("value").alias("text"),
    ).select("*", "place.path", "place.block")
    within = Window.partitionBy("path", "block").orderBy("place")
    log = "algorithm" if name == FOLDER else "path"
    ahead = Window.partitionBy(log).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("algorithm", "path", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("path", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    numbered = rows.withColumn("k", F.row_number().over(within)).join(blocks, ["path", "block"])
    return numbered.selectExpr(*TRACK, "source", "0L as part", "before + k as line", "text")


# --- sinks ------------------------------------------------------------------


def write_tracks_csv(std: DataFrame, path: str) -> None:
    std.select(*TRACK, *POSE, *ANGLES, "source_topic").write.partitionBy(*TRACK).option("header", True).csv(path)


def tum_lines(std: DataFrame) -> DataFrame:
    fmt = " ".join(["%.9f"] * len(POSE))
    return std.select(*TRACK, "timestamp_s", F.format_string(fmt, *POSE).alias("value"))


def write_tum(std: DataFrame, path: str) -> None:
    """Fixed-format text per track, ordered by time inside each file."""
    lines = tum_lines(std)
    lines.repartitionByRange(*TRACK, "timestamp_s").sortWithinPartitions(*TRACK, "timestamp_s").select(
        *TRACK, "value"
    ).write.partitionBy(*TRACK).text(path)


def write_per_track_csv(rows: DataFrame, path: str) -> None:
    """Timeline, resource and flagged-step tables, one folder per track."""
    rows.write.partitionBy(*TRACK).option("header", True).csv(path)


def write_document(rows: DataFrame, path: str) -> None:
    """One JSON document per row."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


def write_cloud(cloud: DataFrame, path: str) -> None:
    cloud.select(*TRACK, "seq", *(F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "intensity"))).write.partitionBy(
        *TRACK
    ).parquet(path)


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_track_metadata(std: DataFrame, path: str) -> None:
    """A JSON document per track: its samples, time range and source."""
    rows = std.groupBy(*TRACK).agg(
        F.expr("count(*) as samples"), F.expr("min(timestamp_s) as start_s"), F.expr("max(timestamp_s) as end_s"),
        F.expr("min(source_topic) as source_topic"),
    )
    write_document(rows, path)


# --- hashing ----------------------------------------------------------------


def file_hashes(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Path, size and SHA-256 of every file below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select(
        F.lit(run_id).alias("run_id"),
        "path",
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def tree_digest(hashes: DataFrame) -> DataFrame:
    """One digest per run over its (path, hash) pairs, in path order.

    Paths are first digested in 256 groups, so no task gathers all of them.
    """
    part = hashes.withColumn("g", F.substring(F.sha2(F.col("path"), 256), 1, 2))
    groups = part.groupBy("run_id", "g").agg(
        F.expr("sha2(array_join(transform(array_sort(collect_list(struct(path, sha256))),"
               " e -> concat(e.path, ' ', e.sha256)), '\\n'), 256) as d"),
        F.expr("count(*) as n"), F.expr("sum(size_bytes) as b"),
    )
    return groups.groupBy("run_id").agg(
        F.expr("sha2(array_join(transform(array_sort(collect_list(struct(g, d))), e -> e.d), '\\n'), 256) as digest"),
        F.expr("sum(n) as files"), F.expr("sum(b) as size_bytes"),
    )


BLOCK_BYTES, FANOUT = 4 << 20, 1024
"""Bytes of a leaf of a file's digest, and digests that one of the next level covers."""


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path and size_bytes of every file below a folder; no content is read. Empty files are passed over, as by all of Spark's readers."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("size_bytes"))


def _read_blocks(block: int):
    def work(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for path, k in zip(batch.column("path").to_pylist(), batch.column("k").to_pylist()):
                if path.startswith("file:"):
                    system, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
                else:
                    system, at = fs.FileSystem.from_uri(path)
                with system.open_input_file(at) as f:
                    out.append(hashlib.sha256(f.read_at(block, k * block)).hexdigest())
            yield batch.append_column("digest", pa.array(out, pa.string()))

    return work


def block_digests(listing: DataFrame, block: int = BLOCK_BYTES, fanout: int = FANOUT) -> DataFrame:
    """path, size_bytes and digest of every file, by a tree over its blocks.

    A leaf is the SHA-256 of a block; a digest of the next level is that of the
    hexadecimal digests it covers, one after the other, until one is left; the
    file's digest is that of its size, a colon and that one. No task holds a file.
    """
    leaves = listing.selectExpr("path", "size_bytes", f"greatest(size_bytes - 1, 0L) div {block}L + 1 as parts")
    leaves = leaves.select("path", "size_bytes", "parts", F.explode(F.expr("sequence(0L, parts - 1)")).alias("k"))
    tasks = max(1, min(10_000, leaves.count() // 64))
    level = keep(leaves.repartition(tasks, "path", "k").mapInArrow(_read_blocks(block), "path string, size_bytes bigint, parts bigint, k bigint, digest string"), "leaves")
    join = "sha2(array_join(transform(array_sort(collect_list(struct(k, digest))), x -> x.digest), ''), 256) as digest"
    while (level.agg(F.max("parts")).first()[0] or 0) > 1:
        above = level.where("parts > 1").withColumn("up", F.expr(f"k div {fanout}")).groupBy("path", "size_bytes", "parts", "up").agg(F.expr(join))
        above = above.selectExpr("path", "size_bytes", f"(parts - 1) div {fanout} + 1 as parts", "up as k", "digest")
        level = keep(above.unionByName(level.where("parts = 1")), "digests")
    return level.select("path", "size_bytes", F.expr("sha2(concat(size_bytes, ':', digest), 256) as digest"))
