"""Raw scan points: validity, time fields, conversion and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .chunks import CHUNK, SEQ_PER_CHUNK, neighbour, running, spread

SCAN = ["run_id", "message_id"]
# Accepted bits of the tag byte, unit scales, gravity.
TAG_MASK, TAG_OK = 0x30, (0x00, 0x10)
TIME_SCALE = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
GRAVITY = 9.80665
MAX_OFFSET = 0xFFFFFFFF


def with_validity(points: DataFrame) -> DataFrame:
    """Flags for the tag and, among valid tags, for finite coordinates."""
    tag_ok = F.col("tag").bitwiseAND(F.lit(TAG_MASK)).isin(*TAG_OK)
    xyz = finite(*(F.col(c).cast("double") for c in "xyz"))
    return points.withColumn("tag_ok", tag_ok).withColumn("xyz_ok", xyz)


def relative_seconds(points: DataFrame, value: str, unit: str, semantics: str) -> DataFrame:
    """Point times in seconds: absolute stamps lose the scan's minimum."""
    if unit not in TIME_SCALE:
        raise ValueError(f"unresolved time unit: {unit}")
    scaled = points.withColumn("time_s", F.col(value).cast("double") * F.lit(TIME_SCALE[unit]))
    if semantics in ("relative_to_header", "relative_to_scan_start"):
        return scaled
    if semantics not in ("absolute", "absolute_from_epoch"):
        raise ValueError(f"unresolved time semantics: {semantics}")
    # A grouped minimum joined back: map-side combined, so a huge scan is not
    # gathered by a window.
    low = scaled.groupBy(*SCAN).agg(F.min("time_s").alias("low"))
    return scaled.join(low, SCAN).withColumn("time_s", F.col("time_s") - F.col("low")).drop("low")


def guessed_point_time(points: DataFrame, value: str, header: str = "header_s") -> DataFrame:
    """Untyped point times: the scan's largest finite value tells the unit."""
    top = (
        points.where(finite(F.col(value).cast("double")))
        .groupBy(*SCAN)
        .agg(F.max(F.col(value).cast("double")).alias("top"))
    )
    return (
        points.join(top, SCAN, "left")
        .withColumn(
            "point_time_s",
            F.expr(
                f"case when top is null then {header} when top > 1e12D then {value} * 1e-9D"
                f" when top > 1e6D then {header} + {value} * 1e-9D else {header} + {value} end"
            ),
        )
        .drop("top")
    )


def _scan_chunks(points: DataFrame, order: str) -> DataFrame:
    return points.withColumn(CHUNK, F.floor(F.col(order) / F.lit(SEQ_PER_CHUNK)).cast("bigint"))


def convert(points: DataFrame) -> DataFrame:
    """Valid points of each scan in time order with the output record fields.

    The order is (offset, ordinal). Its position is counted over offset chunks,
    so a scan of any size stays spread out.
    """
    good = with_validity(points).where("tag_ok and xyz_ok")
    good = good.withColumn(CHUNK, F.expr("cast(floor(offset_ns / 1000000) as bigint)"))
    out = running(good, SCAN, ["offset_ns", "ordinal"], sums={"pos": F.lit(1).cast("bigint")})
    return out.selectExpr(
        *SCAN,
        "pos - 1 as pos",
        "x",
        "y",
        "z",
        "cast(reflectivity as float) as intensity",
        "cast(line as int) as ring",
        "cast(cast(offset_ns as float) * cast(1e-9 as float) as float) as time",
        "offset_ns",
        "ordinal",
    )


def validation_totals(points: DataFrame) -> DataFrame:
    """Counters of the conversion per run, before and after sorting."""
    flagged = with_validity(_scan_chunks(points, "ordinal"))
    prev = neighbour(flagged, SCAN, ["ordinal"], ["offset_ns"], "p")
    out = convert(points)
    after = neighbour(_scan_chunks(out, "pos"), SCAN, ["pos"], ["time"], "p")
    before = prev.groupBy("run_id").agg(
        F.expr("count(*) as input_points"),
        F.expr("count_if(tag_ok and xyz_ok) as output_points"),
        F.expr("count_if(not tag_ok) as invalid_tag_points"),
        F.expr("count_if(tag_ok and not xyz_ok) as non_finite_points"),
        F.expr("count_if(offset_ns < p.offset_ns) as input_time_backtracks"),
        F.expr("cast(min(if(tag_ok and xyz_ok, line, null)) as bigint) as ring_min"),
        F.expr("cast(max(if(tag_ok and xyz_ok, line, null)) as bigint) as ring_max"),
    )
    frames = points.select(*SCAN).distinct().groupBy("run_id").agg(F.expr("count(*) as frames"))
    sorted_out = after.groupBy("run_id").agg(
        F.expr("count_if(time < p.time) as output_time_backtracks"),
        F.expr("cast(min(time) as double) as time_min_s"),
        F.expr("cast(max(time) as double) as time_max_s"),
    )
    return (
        before.join(frames, "run_id")
        .join(sorted_out, "run_id", "left")
        .selectExpr(
            "*",
            "input_points - output_points as dropped_points",
            "if(input_points > 0, (input_points - output_points) / input_points, 0.0D) as dropped_ratio",
        )
    )


def ring_counts(points: DataFrame) -> DataFrame:
    return (
        with_validity(points)
        .where("tag_ok and xyz_ok")
        .groupBy("run_id", "line")
        .agg(F.expr("count(*) as points"))
    )


def to_offsets(points: DataFrame) -> DataFrame:
    """Absolute stamps to offsets from the scan's first point.

    One offset outside uint32 rejects its whole frame. Intensity is rounded
    half to even and clamped to a byte.
    """
    first = points.groupBy(*SCAN).agg(
        F.expr("min_by(point_ns, ordinal) as first_ns"),
        F.expr("min(point_ns) as low"),
        F.expr("max(point_ns) as high"),
    )
    ok = first.where(f"low >= first_ns and high - first_ns <= {MAX_OFFSET}L").select(*SCAN, "first_ns")
    return points.join(ok, SCAN).selectExpr(
        *SCAN,
        "ordinal",
        "point_ns - first_ns as offset_ns",
        "cast(least(greatest(rint(cast(intensity as double)), 0.0D), 255.0D) as smallint) as reflectivity",
    )


def incompatible_layouts(fields: DataFrame, expected: DataFrame) -> DataFrame:
    """Scans whose field table lacks one of the expected (name, offset, type)."""
    scans = fields.select(*SCAN).distinct()
    have = fields.join(expected, ["name", "offset", "datatype"], "left_semi")
    n = have.groupBy(*SCAN).agg(F.expr("count(distinct name) as found"))
    total = expected.select("name").distinct().count()
    return (
        scans.join(n, SCAN, "left")
        .where(F.coalesce(F.col("found"), F.lit(0)) < total)
        .withColumn("found", F.coalesce(F.col("found"), F.lit(0)))
    )


def scale_imu(imu: DataFrame, scale: float = GRAVITY) -> DataFrame:
    """Acceleration from g to SI; the covariance is scaled only if it is set."""
    s = f"{float(scale)!r}D"
    return imu.selectExpr(
        "*",
        *(f"if(unit = 'g', a{k} * {s}, a{k}) as a{k}_si" for k in "xyz"),
        f"if(unit = 'g' and exists(acc_cov, c -> c <> 0), transform(acc_cov, c -> c * {s} * {s}), acc_cov)"
        " as acc_cov_si",
    )


def in_range(points: DataFrame, low: float = 0.5, high: float = 100.0) -> DataFrame:
    r = "sqrt(pow(cast(x as double), 2) + pow(cast(y as double), 2) + pow(cast(z as double), 2))"
    return points.where(finite(*(F.col(c).cast("double") for c in "xyz"))).where(
        f"{r} between {float(low)!r}D and {float(high)!r}D"
    )


def frame_positions(messages: DataFrame, keys=("run_id", "topic")) -> DataFrame:
    """0-based position of each message of a topic, in id order."""
    rows = messages.withColumn(CHUNK, F.expr(f"cast(floor(message_id / {SEQ_PER_CHUNK}) as bigint)"))
    out = running(rows, list(keys), ["message_id"], sums={"frame_no": F.lit(1).cast("bigint")})
    return out.withColumn("frame_no", F.expr("frame_no - 1")).drop(CHUNK)


def read_scans(
    points: DataFrame,
    frames: DataFrame,
    *,
    scan_step: int = 5,
    point_step: int = 20,
    stop_after_s: float | None = None,
    low: float = 0.5,
    high: float = 100.0,
) -> DataFrame:
    """Every n-th scan and point inside the range, up to a stop time.

    ``frames`` has the message id, header time and position. The cheap stride
    and time filters run before the points are touched.
    """
    kept = frames.where(f"frame_no % {int(scan_step)} = 0")
    if stop_after_s is not None:
        kept = kept.where(F.col("header_s") <= stop_after_s)
    rows = points.where(f"ordinal % {int(point_step)} = 0").join(
        kept.select(*SCAN, "header_s"), SCAN
    )
    return in_range(rows, low, high).withColumn(
        "point_time_s", F.expr("header_s + cast(offset_ns as double) * 1e-9D")
    )


def lod_clouds(cloud: DataFrame, position: str, steps: tuple[int, int, int]) -> DataFrame:
    """Dense, medium and sparse strides from one pass over the cloud."""
    dense, medium, sparse = steps
    if not 0 < dense < medium < sparse or medium % dense or sparse % dense:
        raise ValueError("strides must be increasing multiples of the dense stride")
    levels = ", ".join(
        f"struct('{n}' as lod, {s} as step)" for n, s in zip(("dense", "medium", "sparse"), steps)
    )
    return cloud.selectExpr(
        "*", f"explode(filter(array({levels}), l -> {position} % l.step = 0)) as l"
    ).selectExpr(*cloud.columns, "l.lod as lod")


def positions(cloud: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """0-based position ``pos`` and cloud size ``n`` of every point."""
    rows = cloud.withColumn(CHUNK, F.expr(f"cast(floor({seq} / {SEQ_PER_CHUNK}) as bigint)"))
    out = running(rows, keys, [seq], sums={"pos": F.lit(1).cast("bigint")})
    size = cloud.groupBy(*keys).agg(F.expr("count(*) as n"))
    return spread(out, size, keys, keys).withColumn("pos", F.expr("pos - 1")).drop(CHUNK)


def linspace_sample(placed: DataFrame, m: int) -> DataFrame:
    """At most ``m`` evenly spaced points: those at floor(k * (n-1) / (m-1)).

    A point decides for itself whether some k maps to it, so nothing is joined.
    """
    if m == 1:
        return placed.where("pos = 0")
    low = f"cast(ceil(cast(pos as double) * {m - 1} / (n - 1)) as bigint)"
    hit = " or ".join(
        f"({low} + {d} between 0 and {m - 2}"
        f" and floor(cast({low} + {d} as double) * ((n - 1) / {float(m - 1)!r}D)) = pos)"
        for d in (-1, 0, 1)
    )
    return placed.where(f"n <= {m} or pos = n - 1 or {hit}")


def display_stride(placed: DataFrame, cap: int) -> DataFrame:
    return placed.where(f"pos % greatest(1L, n div {int(cap)}L) = 0")
