"""Provenance and label strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_label(kind: Column, cutoff: Column, ramp: Column, sigma: Column) -> Column:
    whole = lambda c: c.cast("bigint").cast("string")
    return (
        F.when(kind == "hard", F.concat(F.lit("hard N="), whole(cutoff)))
        .when(
            kind == "trapeziform",
            F.concat(F.lit("trapeziform N="), whole(cutoff), F.lit(" ramp="), whole(ramp)),
        )
        .when(kind == "gaussian", F.concat(F.lit("gaussian sigma="), sigma.cast("string")))
        .otherwise(F.lit("off"))
    )


def format_value(v: Column) -> Column:
    """Three significant digits in plain notation, trailing zeros trimmed; a dash for non-finite.

    Values outside [1e-6, 1000) in magnitude keep a decimal exponent, as a
    precision-limited label must. Only zeros after the point are trimmed: 120 stays 120.
    """
    mag = F.abs(v)
    e = F.floor(F.log10(F.when(mag > 0, mag).otherwise(F.lit(1.0)))).cast("int")
    # 9.9951 rounds up to 10.0: the exponent is that of the rounded value
    pow10 = lambda k: F.pow(F.lit(10.0), k.cast("double"))
    m3 = F.floor(mag / pow10(e - 2) + 0.5)
    e = F.when(m3 >= 1000, e + 1).otherwise(e)
    m3 = F.when(m3 >= 1000, F.lit(100)).otherwise(m3).cast("int")
    digits = m3.cast("string")
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    trim = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    plain = (
        F.when(e == 2, digits)
        .when(e == 1, trim(F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 1))))
        .when(e == 0, trim(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 2))))
        .when((e < 0) & (e >= -6), trim(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)))
        .otherwise(
            F.concat(
                F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 2), F.lit("e"),
                F.when(e >= 0, F.lit("+")).otherwise(F.lit("-")), F.abs(e).cast("string"),
            )
        )
    )
    finite = v.isNotNull() & ~F.isnan(v) & (mag < float("inf"))
    return F.when(~finite, F.lit("—")).when(v == 0, F.lit("0")).otherwise(F.concat(sign, plain))
