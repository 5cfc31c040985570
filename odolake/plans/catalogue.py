"""All registered queries, by importing the modules that register them."""

from __future__ import annotations

from . import map_queries, report_queries, source_queries, stream_queries, track_queries  # noqa: F401
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
