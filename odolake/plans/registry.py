"""Where the plan modules put their queries and comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import Inputs
from .oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, build: Callable[[Inputs], DataFrame], oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
    if oracle is not None:
        ORACLE[name] = sql(oracle)
