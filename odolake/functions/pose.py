"""Quaternion, rotation and interpolation expressions over plain columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import clamp

QUAT = ("qx", "qy", "qz", "qw")


def quat_norm(q: list[Column]) -> Column:
    return F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))


def normalized(q: list[Column]) -> list[Column]:
    n = quat_norm(q)
    return [c / n for c in q]


def roll_pitch_yaw(q: list[Column]) -> tuple[Column, Column, Column]:
    """Roll, pitch (clamped) and yaw of a unit quaternion (x, y, z, w)."""
    x, y, z, w = q
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(clamp(2 * (w * y - z * x), -1.0, 1.0))
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    return roll, pitch, yaw


def rotation_rows(q: list[Column]) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion."""
    x, y, z, w = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rotate(rows: list[list[Column]], v: list[Column]) -> list[Column]:
    return [r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in rows]


def yaw_rows(c: Column, s: Column) -> list[list[Column]]:
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[c, -s, zero], [s, c, zero], [zero, zero, one]]


@dataclass(frozen=True)
class RigidTransform:
    """Row-major 3x3 rotation and translation held as plan literals."""

    rotation: tuple[float, ...]
    translation: tuple[float, float, float]

    def apply(self, v: list[Column]) -> list[Column]:
        rows = [[F.lit(float(x)) for x in self.rotation[i * 3 : i * 3 + 3]] for i in range(3)]
        return [c + F.lit(float(t)) for c, t in zip(rotate(rows, v), self.translation)]

    def inverse(self) -> "RigidTransform":
        r, t = self.rotation, self.translation
        rt = tuple(r[j * 3 + i] for i in range(3) for j in range(3))
        moved = tuple(-sum(rt[i * 3 + j] * t[j] for j in range(3)) for i in range(3))
        return RigidTransform(rt, moved)


IDENTITY = RigidTransform((1, 0, 0, 0, 1, 0, 0, 0, 1), (0, 0, 0))


def slerp(df: DataFrame, q0: list[str], q1: list[str], f: str, out: list[str]) -> DataFrame:
    """Shortest-arc interpolation of two quaternions given as expressions.

    Nearly parallel pairs fall back to a normalized straight line. Every stage
    is its own projection, so shared terms are computed once and the generated
    code stays small.
    """
    k = range(4)
    df = df.selectExpr("*", *(f"{q0[i]} as __a{i}" for i in k), *(f"{q1[i]} as __b{i}" for i in k))
    norm = "sqrt(" + " + ".join("__{0}%d * __{0}%d" % (i, i) for i in k) + ")"
    df = df.selectExpr("*", f"{norm.format('a')} as __na", f"{norm.format('b')} as __nb")
    raw = " + ".join(f"__a{i} * __b{i}" for i in k)
    df = df.selectExpr("*", f"({raw}) / (__na * __nb) as __raw")
    df = df.selectExpr(
        "*", "if(__raw < 0, -1.0D, 1.0D) as __sign", "least(1.0D, abs(__raw)) as __dot"
    )
    df = df.selectExpr("*", "acos(__dot) as __theta", "__dot > 0.9995D as __flat")
    df = df.selectExpr(
        "*",
        f"if(__flat, 1.0D - {f}, sin((1.0D - {f}) * __theta) / sin(__theta)) / __na as __wa",
        f"if(__flat, {f}, sin({f} * __theta) / sin(__theta)) * __sign / __nb as __wb",
    )
    df = df.selectExpr("*", *(f"__wa * __a{i} + __wb * __b{i} as __m{i}" for i in k))
    df = df.selectExpr("*", f"if(__flat, {norm.format('m')}, 1.0D) as __nm")
    df = df.selectExpr("*", *(f"__m{i} / __nm as {out[i]}" for i in k))
    extra = [f"__{c}{i}" for c in "abm" for i in k]
    return df.drop(*extra, *(f"__{c}" for c in ("na", "nb", "nm", "raw", "sign", "dot", "theta", "flat", "wa", "wb")))
