"""Spherical-harmonic analysis, synthesis and derivatives as joins and sums.

Fields are long tables samples(field_id, comp, i, j, f) on a Gauss-Legendre grid,
spectra are coeffs(field_id, comp, l, m, re, im) with m >= 0, orthonormal with the
Condon-Shortley sign. The transform is separable: a Fourier sum per ring followed by
a Legendre sum over rings, so the work is two aggregations and never a dense product.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbtable.functions.spectral import (
    TAU,
    alpha_down,
    alpha_up,
    angle_cos,
    angle_sin,
    degree_gain,
)
from orbtable.operators.recurrence import legendre_sums, legendre_values
from orbtable.session import dimension

KEYS = ["field_id", "comp"]
# above this many orders the Fourier sums are done ring by ring with an FFT
DIRECT_ORDERS = 16
# above this degree Legendre sums run the recurrence themselves instead of joining a table of its values
TABLE_DEGREES = 64


def _legendre_fold(n: Column, x: Column, finish) -> Column:
    """finish(P_{n-1}(x), P_n(x)) for n >= 1, by one fold over the degrees."""
    steps = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("p0"), x.alias("p1")),
        lambda acc, k: F.struct(
            acc["p1"].alias("p0"),
            (((2 * k - 1) * x * acc["p1"] - (k - 1) * acc["p0"]) / k).alias("p1"),
        ),
        lambda acc: finish(acc["p0"], acc["p1"]),
    )


def rings_for(configs: DataFrame) -> DataFrame:
    """Gauss-Legendre rings of every distinct `nlat` in `configs` (north to south)."""
    return _solve_rings(configs.select(F.col("nlat").cast("int")).where("nlat >= 1").distinct())


def _solve_rings(sizes: DataFrame) -> DataFrame:
    n = F.col("nlat")
    slope = lambda x: lambda p0, p1: n * (x * p1 - p0) / (x * x - 1)
    guess = F.cos(F.lit(math.pi) * (F.col("i") + 0.75) / (n + 0.5))
    # the cosine guess is good to 1e-3: six Newton rounds are past convergence
    node = F.aggregate(
        F.sequence(F.lit(1), F.lit(6)), guess,
        lambda x, _: x - _legendre_fold(n, x, lambda p0, p1: p1 / slope(x)(p0, p1)),
    )
    df = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("ct", node)
    df = df.withColumn("dp", _legendre_fold(n, F.col("ct"), slope(F.col("ct"))))
    one = 1 - F.col("ct") * F.col("ct")
    return df.select(
        "nlat", "i", F.acos("ct").alias("theta"), "ct", F.sqrt(one).alias("st"),
        (2 / (one * F.col("dp") * F.col("dp"))).alias("w"),
    )


def rings(spark: SparkSession, nlat: int) -> DataFrame:
    return dimension(spark, ("rings", nlat), lambda: _solve_rings(spark.range(1).select(F.lit(nlat).alias("nlat"))))


def basis_for(rings_df: DataFrame, lmax: int, mmax: int | None = None) -> DataFrame:
    """basis(nlat, i, l, m, y): normalised associated Legendre values on every ring.

    One row per (ring, m) folds the three-term recurrence into an array, which is then
    exploded; the generator is spread over the cluster, not computed on the driver.
    """
    mmax = lmax if mmax is None else mmax
    m, ct, st = F.col("m"), F.col("ct"), F.col("st")
    amm2 = F.aggregate(
        F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")),
        F.lit(1.0 / (4.0 * math.pi)),
        lambda acc, k: acc * (2 * k + 1) / (2 * k),
    )
    sign = F.when(m % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    df = (
        rings_df.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(mmax))))
        .withColumn("y0", sign * F.sqrt(amm2) * F.pow(st, m.cast("double")))
    )

    def advance(acc, l):
        top = ((2 * l + 1) * (2 * l - 1)).cast("double")
        den = ((l + m) * (l - m)).cast("double")
        a = F.sqrt(top / den)
        b = F.sqrt((2 * l + 1) / (2 * l - 3).cast("double") * ((l - 1 + m) * (l - 1 - m)) / den)
        y = a * ct * acc["p1"] - F.when(l - 1 == m, F.lit(0.0)).otherwise(b * acc["p0"])
        return F.struct(
            acc["p1"].alias("p0"), y.alias("p1"), F.concat(acc["ys"], F.array(y)).alias("ys")
        )

    fold = F.aggregate(
        F.when(m < lmax, F.sequence(m + 1, F.lit(lmax))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(0.0).alias("p0"), F.col("y0").alias("p1"), F.array("y0").alias("ys")),
        advance,
        lambda acc: acc["ys"],
    )
    return (
        df.withColumn("ys", fold)
        .select("nlat", "i", "m", F.posexplode("ys").alias("k", "y"))
        .select("nlat", "i", (F.col("m") + F.col("k")).alias("l"), "m", "y")
    )


def basis(spark: SparkSession, nlat: int, lmax: int, mmax: int | None = None) -> DataFrame:
    """The basis table of one grid, built once; joins see its true size and broadcast it only when small."""
    mm = lmax if mmax is None else mmax
    return dimension(spark, ("basis", nlat, lmax, mm), lambda: basis_for(rings(spark, nlat), lmax, mm)).drop("nlat")


# ------------------------------------------------------------------ Fourier stage


def dft_rings(samples: DataFrame, nphi: int, mmax: int) -> DataFrame:
    """G_m per ring: (2 pi / nphi) * sum_j f exp(-i m phi_j) -> (field_id, comp, i, m, re, im).

    Few orders: one aggregation with two sums per order, all combined map-side, so the
    shuffle carries one row per ring and task. Many orders: one FFT per ring, where a
    ring is nphi values by definition of the grid.
    """
    if mmax <= DIRECT_ORDERS:
        j = F.col("j")
        sums = []
        for m in range(mmax + 1):
            sums.append(F.sum(F.col("f") * angle_cos(m, j, nphi)).alias(f"c{m}"))
            sums.append(F.sum(F.col("f") * angle_sin(m, j, nphi)).alias(f"s{m}"))
        wide = samples.groupBy(*KEYS, "i").agg(*sums)
        h = F.lit(TAU / nphi)
        rows = F.array(*[
            F.struct(F.lit(m).alias("m"), (h * F.col(f"c{m}")).alias("re"), (-h * F.col(f"s{m}")).alias("im"))
            for m in range(mmax + 1)
        ])
        return wide.select(*KEYS, "i", F.inline(rows))

    ring_sums = samples.groupBy(*KEYS, "i", "j").agg(F.sum("f").alias("f"))
    packed = ring_sums.groupBy(*KEYS, "i").agg(F.collect_list(F.struct("j", "f")).alias("row"))

    @F.pandas_udf("array<struct<m:int,re:double,im:double>>")
    def ring_fft(js: pd.Series, fs: pd.Series) -> pd.Series:
        grid = np.zeros((len(js), nphi))
        for k, (j, f) in enumerate(zip(js, fs)):
            grid[k, np.asarray(j)] = f
        g = np.fft.fft(grid, axis=1)[:, np.arange(mmax + 1) % nphi] * (TAU / nphi)
        return pd.Series([
            [{"m": m, "re": float(z.real), "im": float(z.imag)} for m, z in enumerate(row)] for row in g
        ])

    return packed.select(*KEYS, "i", F.inline(ring_fft(F.col("row.j"), F.col("row.f"))))


def _half_spectra(rows: np.ndarray, m: np.ndarray, z: np.ndarray, n: int, nphi: int) -> np.ndarray:
    """Half-spectra (n, nphi div 2 + 1) of rings from their orders; orders beyond the grid fold back onto it."""
    at = m % nphi
    back = 2 * at > nphi
    at, z = np.where(back, nphi - at, at), np.where(back, z.conj(), z)
    # the mean and the highest wave of an even ring stand alone, where others have a conjugate beside them
    alone = (at == 0) | (2 * at == nphi)
    z = np.where(alone, np.where(m == 0, 1, 2) * z.real, z)
    out = np.zeros((n, nphi // 2 + 1), complex)
    np.add.at(out, (rows, at), z)
    return out


def rings_to_grid(modes: DataFrame, nphi: int, mmax: int = 0) -> DataFrame:
    """f_ij = F_0 + 2 sum_{m>0} Re(F_m exp(i m phi_j)) from (field_id, comp, i, m, re, im).

    The orders of one ring are gathered first (at most mmax + 1 of them), so the expansion to nphi columns happens
    after the last shuffle: few orders by their sums, many by one inverse FFT a ring.
    """
    packed = modes.groupBy(*KEYS, "i").agg(
        F.collect_list(F.struct("m", "re", "im")).alias("f")
    )
    return expand_rings(packed, [*KEYS, "i"], ["f"], nphi, mmax)


def expand_rings(packed: DataFrame, keys: list[str], names: list[str], nphi: int, mmax: int, at: str | None = None) -> DataFrame:
    """(keys, j, names): the orders of a ring, an array<struct<m, re, im>> for each name, to its values at all nphi columns.

    With `at`, an array of structs with a field j, there is a row for each of these instead, with their other fields. A ring
    without orders for a name has NULL.
    """
    if mmax > DIRECT_ORDERS:
        @F.pandas_udf("array<double>")
        def ring_values(ms: pd.Series, res: pd.Series, ims: pd.Series) -> pd.Series:
            if not len(ms):
                return pd.Series([], dtype=object)
            rows = np.repeat(np.arange(len(ms)), ms.str.len())
            z = np.concatenate(list(res)) + 1j * np.concatenate(list(ims))
            half = _half_spectra(rows, np.concatenate(list(ms)).astype(int), z, len(ms), nphi)
            return pd.Series(list(np.fft.irfft(half, nphi, axis=1) * nphi))

        value = lambda c: F.when(F.size(c) > 0, ring_values(F.col(c + ".m"), F.col(c + ".re"), F.col(c + ".im")))
        rows = packed.select(*keys, *([at] if at else []), *[value(c).alias(c) for c in names])
        if at:
            return rows.select(*keys, *names, F.inline(at)).select("*", *[F.get(c, F.col("j")).alias("_" + c) for c in names]).drop(*names).withColumnsRenamed({"_" + c: c for c in names})
        columns = F.transform(F.sequence(F.lit(0), F.lit(nphi - 1)), lambda j: F.struct(j.alias("j"), *[F.get(c, j).alias(c) for c in names]))
        return rows.select(*keys, F.inline(columns))
    term = lambda acc, t: acc + F.when(t["m"] == 0, t["re"]).otherwise(
        2 * (t["re"] * angle_cos(t["m"], F.col("j"), nphi) - t["im"] * angle_sin(t["m"], F.col("j"), nphi))
    )
    rows = packed.select(*keys, *names, F.inline(at)) if at else packed.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nphi - 1))))
    value = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), term))
    return rows.select(*[c for c in rows.columns if c not in names], *[value(c).alias(c) for c in names])


def fourier_dphi(samples: DataFrame, nphi: int, mmax: int) -> DataFrame:
    """Longitude derivative on the grid, ring by ring, without a Legendre transform."""
    g = dft_rings(samples, nphi, mmax)
    k = F.col("m") / F.lit(TAU)
    return rings_to_grid(g.select(*KEYS, "i", "m", (-k * F.col("im")).alias("re"), (k * F.col("re")).alias("im")), nphi, mmax)


# ------------------------------------------------------------------ Legendre stage


def _nodes(spark: SparkSession, nlat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ct, st, w) of a grid's rings, as many numbers as the grid has rings."""
    got = rings(spark, nlat).select("i", "ct", "st", "w").toPandas().sort_values("i")
    return got["ct"].to_numpy(), got["st"].to_numpy(), got["w"].to_numpy()


def basis_join(modes: DataFrame, nlat: int, lmax: int, mmax: int | None = None) -> DataFrame:
    """Ring modes (.., i, m, re, im) with the ring weight w and every basis value y(l) of their (i, m)."""
    spark = modes.sparkSession
    return modes.join(rings(spark, nlat).select("i", "w"), "i").join(
        basis(spark, nlat, lmax, mmax), ["i", "m"])


def sh_analysis(samples: DataFrame, nlat: int, nphi: int, lmax: int, mmax: int | None = None) -> DataFrame:
    """Coefficients Q_lm = sum_i w_i y_lm(i) G_m(i); the order m = 0 is real."""
    mm = lmax if mmax is None else mmax
    wy = F.col("w") * F.col("y")
    if lmax > TABLE_DEGREES:
        q = legendre_sums(dft_rings(samples, nphi, mm), KEYS, _nodes(samples.sparkSession, nlat), lmax)
        return q.withColumn("im", F.when(F.col("m") == 0, F.lit(0.0)).otherwise(F.col("im")))
    return (
        basis_join(dft_rings(samples, nphi, mm), nlat, lmax, mm)
        .groupBy(*KEYS, "l", "m")
        .agg(F.sum(wy * F.col("re")).alias("re"), F.sum(wy * F.col("im")).alias("im"))
        .withColumn("im", F.when(F.col("m") == 0, F.lit(0.0)).otherwise(F.col("im")))
    )


def sh_legendre_synth(coeffs: DataFrame, nlat: int, lmax: int, mmax: int | None = None) -> DataFrame:
    """F_m(i) = sum_l Q_lm y_lm(i)."""
    spark = coeffs.sparkSession
    if lmax > TABLE_DEGREES:
        mm = lmax if mmax is None else mmax
        return legendre_values(coeffs.where(F.col("m") <= mm), KEYS, _nodes(spark, nlat), lmax)
    return (
        coeffs.join(basis(spark, nlat, lmax, mmax), ["l", "m"])
        .groupBy(*KEYS, "i", "m")
        .agg(F.sum(F.col("re") * F.col("y")).alias("re"), F.sum(F.col("im") * F.col("y")).alias("im"))
    )


def sh_synthesis(coeffs: DataFrame, nlat: int, nphi: int, lmax: int, mmax: int | None = None) -> DataFrame:
    return rings_to_grid(sh_legendre_synth(coeffs, nlat, lmax, mmax), nphi, lmax if mmax is None else mmax)


def sh_refine(samples: DataFrame, nlat: int, nphi: int, lmax: int, mmax: int | None = None) -> DataFrame:
    """Analysis plus one correction from the residual of its own synthesis."""
    q0 = sh_analysis(samples, nlat, nphi, lmax, mmax)
    back = sh_synthesis(q0, nlat, nphi, lmax, mmax).withColumnRenamed("f", "g")
    resid = samples.join(back, [*KEYS, "i", "j"]).select(*KEYS, "i", "j", (F.col("f") - F.col("g")).alias("f"))
    q1 = sh_analysis(resid, nlat, nphi, lmax, mmax)
    return q0.unionByName(q1).groupBy(*KEYS, "l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


# ------------------------------------------------------------------ coefficient space


def relayout(coeffs: DataFrame, lmax: int, mmax: int | None = None) -> DataFrame:
    """Change the band limit: truncate, or pad with zeros."""
    mm = lmax if mmax is None else mmax
    target = (
        coeffs.select(*KEYS).distinct()
        .withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(lmax))))
        .withColumn("m", F.explode(F.sequence(F.lit(0), F.least(F.col("l"), F.lit(mm)))))
    )
    return target.join(coeffs, [*KEYS, "l", "m"], "left").select(
        *KEYS, "l", "m", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im")
    )


def degree_neighbours(coeffs: DataFrame) -> DataFrame:
    """Each coefficient with its neighbours in degree at the same order (0 beyond the band)."""
    w = Window.partitionBy(*KEYS, "m").orderBy("l")
    pick = lambda c, f: F.coalesce(f(c).over(w), F.lit(0.0))
    return coeffs.select(
        *KEYS, "l", "m",
        pick("re", F.lag).alias("re_below"), pick("im", F.lag).alias("im_below"),
        pick("re", F.lead).alias("re_above"), pick("im", F.lead).alias("im_above"),
    )


def sin_dtheta_coeffs(coeffs: DataFrame) -> DataFrame:
    """Spectrum of sin(theta) * d/dtheta, kept within the same band."""
    l, m = F.col("l"), F.col("m")
    below = F.when(l > m, alpha_up(l - 1, m)).otherwise(F.lit(0.0))
    above = alpha_down(l + 1, m)
    mix = lambda k: (below * F.col(f"{k}_below") + above * F.col(f"{k}_above")).alias(k)
    return degree_neighbours(coeffs).select(*KEYS, "l", "m", mix("re"), mix("im"))


def dphi_coeffs(coeffs: DataFrame) -> DataFrame:
    m = F.col("m")
    return coeffs.select(*KEYS, "l", "m", (-m * F.col("im")).alias("re"), (m * F.col("re")).alias("im"))


def sh_sin_dtheta(coeffs, nlat, nphi, lmax, mmax=None) -> DataFrame:
    """sin(theta) * df/dtheta on the grid, band-limited like its input."""
    return sh_synthesis(sin_dtheta_coeffs(coeffs), nlat, nphi, lmax, mmax)


def sh_dtheta(coeffs, nlat, nphi, lmax, mmax=None) -> DataFrame:
    r = rings(coeffs.sparkSession, nlat).select("i", "st")
    return sh_sin_dtheta(coeffs, nlat, nphi, lmax, mmax).join(r, "i").select(
        *KEYS, "i", "j", (F.col("f") / F.col("st")).alias("f")
    )


def sh_dphi(coeffs, nlat, nphi, lmax, mmax=None) -> DataFrame:
    return sh_synthesis(dphi_coeffs(coeffs), nlat, nphi, lmax, mmax)


# ------------------------------------------------------------------ filters and power


def power_spectrum(coeffs: DataFrame) -> DataFrame:
    """Power per degree over all components; orders m > 0 stand for +m and -m."""
    w = F.when(F.col("m") == 0, 1.0).otherwise(2.0)
    return coeffs.groupBy("field_id", "l").agg(
        F.sum(w * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("p")
    )


def gaussian_gains(specs: DataFrame, lmax: int) -> DataFrame:
    """Gains of exp(-theta^2 / (2 sigma^2)) for specs(spec_id, sigma): Legendre moments / the mean.

    The quadrature runs over x = cos(theta) with max(4 lmax, 200) Gauss nodes.
    """
    nq = max(4 * lmax, 200)
    spark = specs.sparkSession
    node = rings(spark, nq).select("i", "theta", "ct", "w")
    # P_l of all degrees at a node, folded once per node
    x = F.col("ct")
    polys = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(lmax, 1))),
        F.struct(F.lit(0.0).alias("p0"), F.lit(1.0).alias("p1"), F.array(F.lit(1.0)).alias("ps")),
        lambda acc, l: F.struct(
            acc["p1"].alias("p0"),
            (((2 * l - 1) * x * acc["p1"] - (l - 1) * acc["p0"]) / l).alias("p1"),
            F.concat(acc["ps"], F.array(((2 * l - 1) * x * acc["p1"] - (l - 1) * acc["p0"]) / l)).alias("ps"),
        ),
        lambda acc: acc["ps"],
    )
    nodes = node.withColumn("ps", F.slice(polys, 1, lmax + 1))
    # every spec meets every node: nq is a fixed grid size, so this is an expansion, not a product of tables
    expanded = specs.select("spec_id", F.col("sigma").cast("double"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("i"))
    joined = expanded.join(nodes, "i")
    kernel = F.col("w") * F.exp(-F.col("theta") * F.col("theta") / (2 * F.col("sigma") * F.col("sigma")))
    moments = joined.groupBy("spec_id").agg(
        *[F.sum(kernel * F.col("ps")[l]).alias(f"q{l}") for l in range(lmax + 1)]
    )
    rows = F.array(*[
        F.struct(F.lit(l).alias("l"), (F.col(f"q{l}") / F.col("q0")).alias("g")) for l in range(lmax + 1)
    ])
    return moments.select("spec_id", F.inline(rows))


def gains_for(specs: DataFrame, lmax: int) -> DataFrame:
    """gains(spec_id, l, g) of specs(spec_id, kind, cutoff, ramp, sigma, r)."""
    closed = (
        specs.where("kind <> 'gaussian'")
        .withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(lmax))))
        .select("spec_id", "l", degree_gain(
            F.col("kind"), F.col("l"), F.lit(lmax), F.col("cutoff"), F.col("ramp"), F.col("r")).alias("g"))
    )
    return closed.unionByName(gaussian_gains(specs.where("kind = 'gaussian'"), lmax))


def apply_gains(coeffs: DataFrame, gains: DataFrame) -> DataFrame:
    """One filtered spectrum per (field, spec); the spec sweep is rows, not a loop."""
    return coeffs.join(gains, "l").select(
        "field_id", "spec_id", "comp", "l", "m",
        (F.col("re") * F.col("g")).alias("re"), (F.col("im") * F.col("g")).alias("im"),
    )


def band_filter(coeffs: DataFrame, cutoff: int) -> DataFrame:
    return coeffs.where(F.col("l") <= cutoff)


def filter_report(power: DataFrame, gains: DataFrame, lmax: int) -> DataFrame:
    """gain at lmax, share of coefficients kept and share of energy kept, in percent."""
    g, l, p = F.col("g"), F.col("l"), F.col("p")
    out = power.join(gains, "l").groupBy("field_id", "spec_id").agg(
        F.max(F.when(l == lmax, g)).alias("gain_lmax"),
        F.sum((2 * l + 1) * g * g).alias("kept"),
        F.sum(g * g * p).alias("e"),
        F.sum(p).alias("tot"),
    )
    return out.select(
        "field_id", "spec_id", (100 * F.col("gain_lmax")).alias("gain_lmax"),
        (100 * F.col("kept") / ((lmax + 1) ** 2)).alias("kept_pct"),
        (100 * F.col("e") / F.when(F.col("tot") > 0, F.col("tot")).otherwise(1.0)).alias("energy_pct"),
    )


def cum_degree_energy(power: DataFrame) -> DataFrame:
    """Energy kept by every hard cut-off at once: a running sum over the degrees of a field."""
    run = Window.partitionBy("field_id").orderBy("l").rowsBetween(Window.unboundedPreceding, 0)
    tot = F.sum("p").over(Window.partitionBy("field_id"))
    return power.select(
        "field_id", "l",
        (100 * F.sum("p").over(run) / F.when(tot > 0, tot).otherwise(1.0)).alias("energy_pct"),
    )


def relative_spectrum(power: DataFrame) -> DataFrame:
    top = F.max("p").over(Window.partitionBy("field_id"))
    rel = F.col("p") / F.when(top > 0, top).otherwise(1.0)
    return power.select(
        "field_id", "l", rel.alias("rel"), F.log10(F.greatest(rel, F.lit(1e-30))).alias("log10_rel")
    )


def flat_layout(coeffs: DataFrame, lmax: int, mmax: int | None = None) -> DataFrame:
    """m-major interleaved re/im array per component; at most 2 * nlm values by the band limit."""
    pos = (F.col("m") * (lmax + 1) - F.floor(F.col("m") * (F.col("m") - 1) / 2) + F.col("l") - F.col("m")).cast("int")
    packed = coeffs.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct(pos.alias("k"), "re", "im"))).alias("q")
    )
    return packed.select(
        *KEYS, F.size("q").alias("nlm"),
        F.flatten(F.transform("q", lambda t: F.array(t["re"], t["im"]))).alias("q"),
    )


def parseval_normalise(coeffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Centre and rms-scale a surface given as comps x, y, z.

    Returns (frame(field_id, cx, cy, cz, scale), normalised coeffs). A surface of zero
    radius raises, as it has no scale.
    """
    y00 = 1.0 / (2.0 * math.sqrt(math.pi))
    mean = (F.col("l") == 0) & (F.col("m") == 0)
    w = F.when(F.col("m") == 0, 1.0).otherwise(2.0)
    e = F.when(mean, 0.0).otherwise(w * (F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    centre = lambda k: F.sum(F.when(mean & (F.col("comp") == k), F.col("re") * y00)).alias("c" + k)
    frame = coeffs.groupBy("field_id").agg(
        centre("x"), centre("y"), centre("z"), F.sqrt(F.sum(e) / (4 * math.pi)).alias("scale")
    ).withColumn(
        "scale",
        F.when(F.col("scale") > 0, F.col("scale")).otherwise(
            F.raise_error(F.lit("degenerate surface: zero rms radius")).cast("double")),
    )
    normal = coeffs.join(frame.select("field_id", "scale"), "field_id").select(
        *KEYS, "l", "m",
        F.when(mean, 0.0).otherwise(F.col("re") / F.col("scale")).alias("re"),
        F.when(mean, 0.0).otherwise(F.col("im") / F.col("scale")).alias("im"),
    )
    return frame, normal
