"""Log-line rules and small string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity, case-insensitive pattern, description; first match wins.
LOG_RULES = (
    (
        "CRITICAL",
        r"NotEnoughMemoryException|terminate called|process has died|segmentation fault|out of memory|\bOOM\b",
        "process died or memory ran out",
    ),
    (
        "HIGH",
        r"\[(?:ERROR|FATAL|CRITICAL)\]|\b(abort|exception|assert)\b|loop back|lidar loop back|imu loop back",
        "error, exception or sensor time going back",
    ),
    (
        "MEDIUM",
        r"Excessive time|HARD time lag|timestamps? went backwards|Observation discarded|non-valid|discarded as",
        "time synchronisation, deskew or data validity warning",
    ),
)

# Name parts a metric may not carry without ground truth.
TRUTH_ONLY_NAMES = ("ate", "rpe", "rmse", "absolute_error", "accuracy")


def first_rule(line: Column, field: int) -> Column:
    out = None
    for rule in LOG_RULES:
        hit = line.rlike("(?i)" + rule[1])
        value = F.lit(rule[field])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def severity(line: Column) -> Column:
    return first_rule(line, 0)


def description(line: Column) -> Column:
    return first_rule(line, 2)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def claims_truth(name: Column) -> Column:
    return F.lower(name).rlike("|".join(TRUTH_ONLY_NAMES))


def iso_seconds(c: Column) -> Column:
    """ISO-8601 text to epoch seconds; text without an offset is read as UTC."""
    return F.unix_micros(c.try_cast("timestamp")) / F.lit(1e6)
