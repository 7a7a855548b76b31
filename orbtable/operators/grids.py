"""Grid rules and value-range statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbtable.operators.rank import order_statistics

# fixed values: range floors, share of the curvature span, oversampling rules
RANGE_FLOOR_REL = 1e-2
RANGE_FLOOR_ABS = 1e-9
CURVATURE_FLOOR_REL = 0.03
DISPLAY_ROWS = 512
DISPLAY_MAX = 8
ROUGH_CHART = 0.25


def grid_problems() -> Column:
    """Violated grid constraints of columns lmax, mmax, nlat, nphi, joined by '; '."""
    lmax, mmax, nlat, nphi = (F.col(c) for c in ("lmax", "mmax", "nlat", "nphi"))
    say = lambda bad, text: F.when(bad, F.lit(text))
    return F.concat_ws(
        "; ",
        say(lmax < 1, "lmax below 1"),
        say((mmax < 0) | (mmax > lmax), "mmax outside 0..lmax"),
        say(nlat <= lmax, "nlat must exceed lmax"),
        say(nphi < 2 * mmax + 1, "nphi below 2*mmax+1"),
    )


def analysis_oversample(piecewise_linear: Column, roughness: Column) -> Column:
    return F.when(piecewise_linear, 4).when(roughness > ROUGH_CHART, 3).otherwise(2)


def display_oversample(lmax: Column) -> Column:
    out = F.lit(DISPLAY_MAX)
    k = DISPLAY_MAX // 2
    while k >= 1:
        out = F.when(k * (lmax + 1) >= DISPLAY_ROWS, F.lit(k)).otherwise(out)
        k //= 2
    return out


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_only(df: DataFrame, value: str) -> DataFrame:
    return df.where(is_finite(F.col(value)))


def floor_range(lo: Column, hi: Column, rel: float = RANGE_FLOOR_REL, floor: float = RANGE_FLOOR_ABS) -> tuple[Column, Column]:
    """Widen [lo, hi] about its middle to the smallest span worth showing."""
    span = F.greatest(F.lit(floor), rel * F.greatest(F.abs(lo), F.abs(hi)))
    wide = hi - lo >= span
    mid = (lo + hi) / 2
    return F.when(wide, lo).otherwise(mid - span / 2), F.when(wide, hi).otherwise(mid + span / 2)


def robust_range(df: DataFrame, keys: list[str], value: str, curvature: bool = False) -> DataFrame:
    """2 % and 98 % order statistics of the finite values, widened; exact on all rows, no stride sample.

    A group without a finite value has the range 0 to 1.
    """
    q = order_statistics(finite_only(df, value), keys, value, {"lo": ("round", 0.02), "hi": ("round", 0.98)})
    lo, hi = floor_range(F.col("lo"), F.col("hi"))
    out = q.select(*keys, lo.alias("lo"), hi.alias("hi"))
    if curvature:
        lo, hi = floor_range(F.col("lo"), F.col("hi"), CURVATURE_FLOOR_REL, 0.0)
        out = out.select(*keys, lo.alias("lo"), hi.alias("hi"))
    return df.select(*keys).distinct().join(out, keys, "left").select(
        *keys, F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))


def ring_mean(samples: DataFrame, nlat: int) -> DataFrame:
    """NaN-skipping mean of the first and last ring, the values of the two pole caps."""
    f = F.when(~F.isnan("f"), F.col("f"))
    return (
        samples.where(F.col("i").isin(0, nlat - 1))
        .groupBy("field_id", "comp", F.when(F.col("i") == 0, "start").otherwise("end").alias("cap"))
        .agg(F.avg(f).alias("f"))
    )
