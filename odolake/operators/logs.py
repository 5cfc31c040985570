"""Log findings: severity per line, groups, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import description, severity, strip
from .tracks import TRACK



def findings(lines: DataFrame) -> DataFrame:
    """Lines that match a rule; the whole line is searched."""
    return (
        lines.withColumn("severity", severity(F.col("text")))
        .where("severity is not null")
        .withColumn("description", description(F.col("text")))
        .withColumn("text", strip(F.col("text")))
    )


def finding_groups(found: DataFrame, examples: int = 6) -> DataFrame:
    """Count, first line and first examples per (severity, source, description).

    Counts combine map-side; examples are cut per group before they are listed.
    """
    key = [*TRACK, "severity", "source", "description"]
    by = ", ".join(key)
    counts = found.groupBy(*key).agg(F.expr("count(*) as findings"), F.expr("min(line) as first_line"))
    heads = (
        found.selectExpr("*", f"row_number() over (partition by {by} order by line, part) as k")
        .where(f"k <= {int(examples)}")
        .groupBy(*key)
        .agg(F.expr("array_sort(collect_list(struct(line, part, text))) as examples"))
    )
    return counts.join(heads, key, "left")


def severity_by_track(found: DataFrame) -> DataFrame:
    return found.groupBy(*TRACK).agg(
        F.expr("count(*) as findings"),
        F.expr("count_if(severity in ('CRITICAL', 'HIGH')) as serious_findings"),
    )


def serious(groups: DataFrame, categories: DataFrame) -> DataFrame:
    """Critical and high groups, plus one made-up finding for a crash without any."""
    high = groups.where("severity in ('CRITICAL', 'HIGH')")
    crash = categories.where("category = 'RUNTIME_CRASH'").join(high, TRACK, "left_anti").selectExpr(
        *TRACK, "category", "'CRITICAL' as severity", "'' as source", "'algorithm run crashed' as description",
        "0L as findings",
    )
    listed = high.join(categories.select(*TRACK, "category"), TRACK).select(
        *TRACK, "category", "severity", "source", "description", "findings"
    )
    return listed.unionByName(crash)


def classify_run(runs: DataFrame) -> DataFrame:
    """Run status from log text, exit code and odometry count."""
    t = "lower(log)"
    return runs.withColumn(
        "run_class",
        F.expr(
            f"case when contains({t}, 'out of memory') or contains({t}, 'bad_alloc') then 'OUT_OF_MEMORY'"
            f" when contains({t}, 'time sync') or (contains({t}, 'timestamp') and contains({t}, 'invalid'))"
            " then 'TIME_SYNC_FAILED' when exit_code <> 0 then 'RUNTIME_CRASH'"
            " when odometry_count = 0 then 'NO_ODOMETRY' else 'SUCCESS' end"
        ),
    )


def resource_time(texts: DataFrame) -> DataFrame:
    """Peak RSS and elapsed wall time from a time report's text."""
    rss = F.regexp_extract("text", r"Maximum resident set size \(kbytes\): (\d+)", 1)
    wall = strip(F.regexp_extract("text", r"Elapsed \(wall clock\) time .*: (.+)", 1))
    return texts.withColumn("max_rss_kb", F.when(rss != "", rss.cast("bigint"))).withColumn(
        "elapsed_wall", F.when(wall != "", wall)
    )
