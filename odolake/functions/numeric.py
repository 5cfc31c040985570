"""Scalar column expressions. All stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(*cols: Column | str) -> Column:
    """True where every argument is neither null, NaN nor infinite."""
    out = F.lit(True)
    for c in map(col, cols):
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out


def r6(c: Column | str) -> Column:
    """Six digits and no negative zero: the comparison form of a double."""
    return F.round(col(c), 6) + F.lit(0.0)


def norm3(x: Column | str, y: Column | str, z: Column | str) -> Column:
    x, y, z = col(x), col(y), col(z)
    return F.sqrt(x * x + y * y + z * z)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def unwrap_correction(delta: Column) -> Column:
    """Multiple of 2*pi that brings a step back into [-pi, pi].

    Steps below pi are left alone; a step of exactly +pi keeps its sign.
    """
    two_pi = F.lit(2.0 * PI)
    folded = F.pmod(delta + F.lit(PI), two_pi) - F.lit(PI)
    folded = F.when((folded == F.lit(-PI)) & (delta > 0), F.lit(PI)).otherwise(folded)
    return F.when(F.abs(delta) < F.lit(PI), F.lit(0.0)).otherwise(folded - delta)


# Magnitude classes per factor of e, and the shift that keeps them positive for
# every double (ln of the smallest subnormal is about -745).
CLASSES_PER_E = 256
CLASS_SHIFT = 200_000


def magnitude_class(c: Column) -> Column:
    """An order-preserving BIGINT class of a double, about 0.4 % wide."""
    size = F.floor(F.log(F.abs(c)) * F.lit(float(CLASSES_PER_E))) + F.lit(CLASS_SHIFT)
    return (
        F.when(c == 0.0, F.lit(0)).when(c > 0.0, size).otherwise(-size).cast("bigint")
    )


def voxel(c: Column | str, size: float | Column) -> Column:
    size = F.lit(float(size)) if not isinstance(size, Column) else size
    return F.floor(col(c).cast("double") / size).cast("bigint")
