"""Tables written once to the shared folder and read by several later passes.

Writing cuts the lineage: later plans start from a scan with column pruning,
pushed filters and real sizes, and a lost executor costs nothing, as the files
do not live on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_dir


def keep(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` below the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete the files of kept tables that no later plan reads; other tables are left alone."""
    for table in tables:
        path = table.__dict__.pop("_kept_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
