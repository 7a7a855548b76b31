"""Three-vectors of columns: a vector is a plain tuple of three Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    """Columns <prefix>x, <prefix>y, <prefix>z."""
    return tuple(F.col(prefix + k) for k in "xyz")


def sub(p: Vec, q: Vec) -> Vec:
    return tuple(s - t for s, t in zip(p, q))


def add(*vs: Vec) -> Vec:
    out = vs[0]
    for w in vs[1:]:
        out = tuple(s + t for s, t in zip(out, w))
    return out


def scale(p: Vec, k) -> Vec:
    return tuple(s * k for s in p)


def dot(p: Vec, q: Vec) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def cross(p: Vec, q: Vec) -> Vec:
    return (
        p[1] * q[2] - p[2] * q[1],
        p[2] * q[0] - p[0] * q[2],
        p[0] * q[1] - p[1] * q[0],
    )


def norm(p: Vec) -> Column:
    return F.sqrt(dot(p, p))


def named(p: Vec, prefix: str) -> list[Column]:
    return [c.alias(prefix + k) for c, k in zip(p, "xyz")]


def unit_columns(p: Vec, prefix: str) -> list[Column]:
    """Normalised vector; a zero vector stays zero."""
    n = norm(p)
    n = F.when(n > 0, n).otherwise(F.lit(1.0))
    return [(c / n).alias(prefix + k) for c, k in zip(p, "xyz")]


def direction(theta: Column, phi: Column, r=None) -> Vec:
    out = (F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta))
    return out if r is None else scale(out, r)


def fence(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """Select `keep` plus computed columns through a one-element inline().

    Catalyst pushes filters through projections by substituting the computed columns,
    which multiplies long geometric expressions; it cannot push them through a generator,
    so every column behind a fence is computed exactly once.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))
