"""Comparison form of a result: rounded doubles, BIGINT integers, flat arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import r6

INTS = (T.ByteType, T.ShortType, T.IntegerType)


def tidy(df: DataFrame, *cols: str) -> DataFrame:
    if cols:
        df = df.selectExpr(*cols)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = r6(c.cast("double"))
        elif isinstance(f.dataType, INTS):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, ";")
        out.append(c.alias(f.name))
    return df.select(*out)
