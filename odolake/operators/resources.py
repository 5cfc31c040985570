"""Resource samples, clock mapping and their alignment to pose time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_seconds
from .asof import bracket, nearest
from .keep import keep
from .quantiles import Stat, exact_quantiles
from .tracks import TRACK

MIB = "1048576.0D"
RESOURCE_MAX_AGE_S = 1.0
STRICT = "strict/clock-anchored"
APPROXIMATE = "approximate/lifecycle-aligned"
NO_TIME = "trajectory-only"


def usable_anchors(anchors: DataFrame) -> DataFrame:
    return anchors.selectExpr(
        *TRACK,
        "cast(wall_time_ns as double) * 1e-9D as w",
        "coalesce(ros_time_s, cast(ros_time_ns as double) * 1e-9D) as r",
    ).where("w is not null and r is not null")


def map_clock(samples: DataFrame, anchors: DataFrame, *, wall: str = "wall_s") -> DataFrame:
    """Piecewise-linear wall clock to recorded clock; null outside the anchors.

    At a shared knot the earlier interval wins, and an interval of zero width
    gives its left value: both mean the smallest value at that wall time.
    """
    knots = usable_anchors(anchors).groupBy(*TRACK, "w").agg(
        F.expr("min(r) as r_low"), F.expr("max(r) as r_high"), F.expr("count(*) as copies")
    )
    # One row per track. Written, so that its size is known and the samples are not shuffled by track.
    many = keep(knots.groupBy(*TRACK).agg(F.expr("sum(copies) as n_anchors")), "anchor_counts")
    out = bracket(
        samples, knots, TRACK, t=wall, sample_t="w", payload=["r_low", "r_high"], exact="after"
    )
    out = out.join(many, TRACK, "left")
    mapped = (
        f"case when n_anchors < 2 or after is null then null"
        f" when after.t = {wall} and before is null then after.r_low"
        f" when before is null then null"
        f" else before.r_high + (({wall} - before.t) / (after.t - before.t)) * (after.r_low - before.r_high) end"
    )
    return out.withColumn("recorded_time_s", F.expr(mapped)).drop("before", "after", "n_anchors")


def offset_evidence(profile: DataFrame) -> DataFrame:
    """Recorded-minus-header offset of the LiDAR topic and its warnings."""
    return profile.selectExpr(
        "run_id",
        "topic",
        "rmh_count",
        "case when coalesce(rmh_count, 0) >= 1 then rmh_median end as offset_s",
        "rmh_mean",
        "rmh_std",
        "recorded_first_s",
        "case when rmh_median is null or coalesce(rmh_count, 0) < 1 then 'missing offset evidence'"
        " when rmh_std > 0.05D then 'offset varies' end as warning",
    )


def playback_events(events: DataFrame) -> DataFrame:
    """First event per track that says playback is running."""
    return (
        events.where("bag_playback = 'running' and at is not null")
        .groupBy(*TRACK)
        .agg(F.expr("min_by(at, pos) as playback_at"))
        .withColumn("playback_s", iso_seconds(F.col("playback_at")))
    )


def align(
    samples: DataFrame,
    anchors: DataFrame,
    events: DataFrame,
    evidence: DataFrame,
    *,
    playback_rate: float = 1.0,
) -> DataFrame:
    """Every sample with its alignment tier and, where aligned, its pose time.

    Two or more anchors make the tier strict, with no fallback when they cover
    nothing. Otherwise a playback event gives the approximate tier, else none.
    ``samples`` needs ``wall_s`` (null when its time text was unreadable).
    """
    tiers = (
        samples.select(*TRACK)
        .distinct()
        .join(anchors.groupBy(*TRACK).agg(F.expr("count(*) as n_anchors")), TRACK, "left")
        .join(playback_events(events), TRACK, "left")
        .join(evidence.select("run_id", "offset_s", "recorded_first_s"), "run_id", "left")
        .selectExpr(
            *TRACK,
            "offset_s",
            "recorded_first_s",
            "playback_s",
            f"case when offset_s is null then '{NO_TIME}'"
            f" when coalesce(n_anchors, 0) >= 2 then '{STRICT}'"
            f" when playback_s is null or recorded_first_s is null or {playback_rate!r} <= 0"
            f" then '{NO_TIME}' else '{APPROXIMATE}' end as tier",
        )
    )
    mapped = map_clock(samples, anchors).withColumnRenamed("recorded_time_s", "strict_s")
    # One row per track, written like the counts of the anchors.
    out = mapped.join(keep(tiers, "tiers"), TRACK).withColumn(
        "recorded_time_s",
        F.expr(
            f"case tier when '{STRICT}' then strict_s when '{APPROXIMATE}'"
            f" then recorded_first_s + (wall_s - playback_s) * {playback_rate!r}D end"
        ),
    )
    return out.withColumn("trajectory_time_s", F.expr("recorded_time_s - offset_s")).drop(
        "strict_s", "offset_s", "recorded_first_s", "playback_s"
    )


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """Mode per track with aligned and outside counts; a strict track that
    aligned nothing is reported as unaligned."""
    return aligned.groupBy(*TRACK).agg(
        F.expr("count(*) as samples"),
        F.expr("count(trajectory_time_s) as aligned_samples"),
        F.expr(f"count_if(tier = '{STRICT}' and recorded_time_s is null) as outside_anchor_samples"),
        F.expr(
            f"if(count(trajectory_time_s) = 0, '{NO_TIME}', max(tier)) as time_alignment_mode"
        ),
    )


def run_mode(summary: DataFrame) -> DataFrame:
    """Weakest mode that produced samples: approximate, then strict, then none."""
    return summary.groupBy("run_id").agg(
        F.expr(
            f"case when bool_or(time_alignment_mode = '{APPROXIMATE}') then '{APPROXIMATE}'"
            f" when bool_or(time_alignment_mode = '{STRICT}') then '{STRICT}'"
            f" else '{NO_TIME}' end as time_alignment_mode"
        )
    )


def bag_relative(aligned: DataFrame, origin: DataFrame) -> DataFrame:
    """Aligned samples on the run's time axis with MiB."""
    return aligned.where("trajectory_time_s is not null and not isnan(trajectory_time_s)").join(
        origin.select("run_id", "origin_s"), "run_id"
    ).selectExpr(
        *TRACK,
        "seq",
        "tier",
        "trajectory_time_s as timestamp_s",
        "trajectory_time_s - origin_s as bag_time_s",
        "recorded_time_s as recorded_timestamp_s",
        "cpu_percent",
        f"cast(rss_bytes as double) / {MIB} as rss_mib",
        "threads",
        "write_bytes",
    )


def attach(timeline: DataFrame, resources: DataFrame, max_age_s: float = RESOURCE_MAX_AGE_S, rows=None) -> DataFrame:
    """Nearest resource sample per timeline row (later one on a tie)."""
    fields = ["cpu_percent", "rss_mib", "threads", "write_bytes", "tier"]
    out = nearest(
        timeline, resources, TRACK, t="bag_time_s", sample_t="bag_time_s", order=["seq"],
        payload=fields, tie="later", max_age=max_age_s, **({"rows": rows} if rows else {}),
    )
    return out.selectExpr(
        *timeline.columns,
        "age_s as resource_age_s",
        *(f"hit.{f} as {f if f != 'tier' else 'resource_alignment_mode'}" for f in fields),
    )


def cpu_distribution(samples: DataFrame) -> DataFrame:
    """Median, linear P95 and peak CPU per track; zeros for a track without samples."""
    clean = samples.selectExpr(*TRACK, "coalesce(cpu_percent, 0.0D) as cpu")
    q = exact_quantiles(
        clean, TRACK, "cpu", [Stat("median_cpu_percent"), Stat("p95_cpu_percent", 0.95)]
    )
    peak = clean.groupBy(*TRACK).agg(F.expr("max(cpu) as peak_cpu_percent"))
    return peak.join(q.drop("n"), TRACK, "left").na.fill(
        0.0, ["median_cpu_percent", "p95_cpu_percent", "peak_cpu_percent"]
    )


def summary(samples: DataFrame, totals: bool = False) -> DataFrame:
    """Means and peaks per track; with ``totals`` also per run (no algorithm) and over all (no run)."""
    return (samples.rollup(*TRACK) if totals else samples.groupBy(*TRACK)).agg(
        F.expr("count(*) as samples"),
        F.expr("avg(cpu_percent) as mean_cpu_percent"),
        F.expr("max(cpu_percent) as peak_cpu_percent"),
        F.expr(f"avg(rss_bytes) / {MIB} as mean_rss_mib"),
        F.expr(f"max(rss_bytes) / {MIB} as peak_rss_mib"),
        F.expr("max(threads) as peak_threads"),
        F.expr("max(write_bytes) as disk_write_bytes"),
    )


def summary_with_medians(samples: DataFrame) -> DataFrame:
    """``summary`` of every level with the exact median and linear P95 CPU of each.

    A row counts once in each level; the levels are narrowed together.
    """
    levels = "inline(array(struct(2 as level, run_id as r, algorithm as a), struct(1 as level, run_id as r, '' as a), struct(0 as level, '' as r, '' as a)))"
    rows = samples.where("cpu_percent is not null").selectExpr("cpu_percent as cpu", levels)
    stats = [Stat("median_cpu_percent"), Stat("p95_cpu_percent", 0.95)]
    q = exact_quantiles(rows, ["level", "r", "a"], "cpu", stats).drop("n")
    level = "if(run_id is null, 0, if(algorithm is null, 1, 2))"
    top = summary(samples, totals=True).selectExpr("*", f"{level} as level", "coalesce(run_id, '') as r", "coalesce(algorithm, '') as a")
    return top.join(q, ["level", "r", "a"], "left").drop("level", "r", "a")


def latest_n(samples: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` samples per track. The rank filter becomes a group limit
    that each map task applies before the shuffle."""
    keys = ", ".join(TRACK)
    by = ", ".join(f"{c} desc" for c in order)
    return samples.selectExpr("*", f"row_number() over (partition by {keys} order by {by}) as back").where(
        f"back <= {int(n)}"
    )


def tops_proxy(summary_rows: DataFrame, nominal_ghz: float | None, fp32_ops: float | None) -> DataFrame:
    """Mean CPU as FP32 tera-operations at nominal clock; null without hardware data."""
    if nominal_ghz is None or fp32_ops is None:
        return summary_rows.withColumn("mean_tops_at_nominal", F.lit(None).cast("double"))
    return summary_rows.withColumn(
        "mean_tops_at_nominal",
        F.expr(f"mean_cpu_percent / 100.0D * {float(nominal_ghz)!r}D * {float(fp32_ops)!r}D / 1000.0D"),
    )


def monitor_state(records: DataFrame) -> DataFrame:
    """Normalized state of a resource record."""
    return records.withColumn(
        "monitor_state",
        F.expr(
            "case when status = 'finished' then 'finished' when status = 'live' then 'live'"
            " when coalesce(samples, 0) > 0 and coalesce(wall_time_s, 0) <> 0 then 'finished_legacy'"
            " else 'missing_or_invalid' end"
        ),
    )


def freshest(records: DataFrame) -> DataFrame:
    """The record to show per run: the active one while the run is running,
    else the newest of the others."""
    return (
        records.where("record_present and (not is_current or run_state = 'running')")
        .groupBy("run_id")
        .agg(
            F.expr(
                "max_by(algorithm, struct(is_current, modified_ns, -candidate_pos)) as algorithm"
            )
        )
    )
