"""A stated set of query vectors against all vectors, in blocks.

Vectors are dealt into blocks of about BLOCK rows by a hash of their id, queries
into blocks of about QUERIES; a task sees one pair of blocks, so that its memory
is bounded, whatever the table's size. Each pair keeps k rows per query and Spark
ranks those.

Cases: a vector that is null or holds null or non-finite components takes no
part, nor does a null id. Only vectors of equal length meet. Rows with one id are
one row each as candidates; as queries they count once. Rows with the query's id
are never its candidates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 1024, 1024


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array of double), dim."""
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return rows.withColumn("dim", F.size("v"))


def matrix(table: pa.Table, column: str, dim: int) -> np.ndarray:
    flat = table[column].combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), dim)


def search(rows: DataFrame, queries: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest scores of each query, ties to the smaller id.

    ``work(ids, vectors, query_ids, query_vectors)`` returns (query's index,
    vector's index, score) of at least the k highest of the pair of blocks.
    """
    n, m = rows.count(), queries.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    a = rows.withColumn("block", F.expr(f"pmod(xxhash64(id), {blocks})")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    b = queries.dropDuplicates(["id"]).withColumn("part", F.expr(f"cast(pmod(xxhash64(id), {groups}) as int)")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    kind = {"long": pa.int64(), "double": pa.float64()}[score]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim = left["dim"][0].as_py()
        ids, asked = left["id"].to_numpy(), right["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        q, v, s = work(ids[order], matrix(left, "v", dim)[order], asked, matrix(right, "v", dim))
        return pa.table([asked[q], ids[order][v], s], schema=schema)

    found = a.groupBy("dim", "block", "part").cogroup(b.groupBy("dim", "block", "part")).applyInArrow(pair, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
