import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbtable.operators import spectral as sp
from orbtable.sources import generate, sinks


def spectrum(spark, lmax=5):
    return generate.random_spectrum(spark.range(1).select(F.lit("a").alias("field_id"), F.lit(7).alias("seed")), lmax)


def close(a, b, keys, cols, tol=1e-11):
    m = a.merge(b, on=keys, suffixes=("", "_w"))
    assert len(m) == len(a) == len(b)
    for c in cols:
        np.testing.assert_allclose(m[c], m[c + "_w"], atol=tol)


def test_rings_match_numpy(spark):
    for n in (2, 5, 64):
        x, w = np.polynomial.legendre.leggauss(n)
        g = sp.rings_for(spark.range(1).select(F.lit(n).alias("nlat"))).orderBy("i").toPandas()
        np.testing.assert_allclose(g["ct"], x[::-1], atol=1e-14)
        np.testing.assert_allclose(g["w"], w[::-1], atol=1e-13)


def test_round_trip(spark):
    q = spectrum(spark)
    back = sp.sh_analysis(sp.sh_synthesis(q, 8, 16, 5), 8, 16, 5)
    close(back.toPandas(), q.toPandas(), ["l", "m"], ["re", "im"])


def test_fft_route_equals_direct_sums(spark, monkeypatch):
    f = sp.sh_synthesis(spectrum(spark), 8, 16, 5)
    direct = sp.dft_rings(f, 16, 5).toPandas()
    monkeypatch.setattr(sp, "DIRECT_ORDERS", -1)
    close(sp.dft_rings(f, 16, 5).toPandas(), direct, ["i", "m"], ["re", "im"])


@pytest.mark.parametrize("nphi, mmax", [(16, 5), (15, 9), (8, 20), (7, 20), (1024, 512)])
def test_inverse_fft_equals_sums_over_orders(spark, monkeypatch, nphi, mmax):
    """Even and odd rings, orders that fold back several times, rings that lack some orders, and 512 orders."""
    rng = np.random.default_rng(nphi)
    rows = [("a", k, i, m, *map(float, rng.normal(size=2))) for k in range(2) for i in range(3) for m in range(mmax + 1) if m != i + 1]
    modes = spark.createDataFrame(rows, "field_id string, comp int, i int, m int, re double, im double")
    monkeypatch.setattr(sp, "DIRECT_ORDERS", -1)
    got = sp.rings_to_grid(modes, nphi, mmax).toPandas()
    j, want = np.arange(nphi), {}
    for _, k, i, m, re, im in rows:
        z = (re + 1j * im * (m > 0)) * np.exp(2j * np.pi * m * j / nphi) * (2 if m else 1)
        want[k, i] = want.get((k, i), 0) + z.real
    frame = pd.DataFrame([("a", k, i, int(x), float(f)) for (k, i), fs in want.items() for x, f in zip(j, fs)], columns=["field_id", "comp", "i", "j", "f"])
    close(got, frame, ["field_id", "comp", "i", "j"], ["f"], 1e-9)


def test_recurrence_equals_the_table(spark, monkeypatch):
    """Analysis and synthesis with and without a table of basis values, to 1e-12, also with few orders and blocks of rings."""
    q = spectrum(spark, 31)
    for mmax in (31, 4):
        part = q.where(F.col("m") <= mmax)
        fm, f = sp.sh_legendre_synth(part, 40, 31, mmax), sp.sh_synthesis(part, 40, 72, 31, mmax)
        table = fm.toPandas(), sp.sh_analysis(f, 40, 72, 31, mmax).toPandas()
        with monkeypatch.context() as patch:
            patch.setattr(sp, "TABLE_DEGREES", 0)
            patch.setattr("orbtable.operators.recurrence.RINGS", 16)
            close(sp.sh_legendre_synth(part, 40, 31, mmax).toPandas(), table[0], ["comp", "i", "m"], ["re", "im"], 1e-12)
            close(sp.sh_analysis(f, 40, 72, 31, mmax).toPandas(), table[1], ["comp", "l", "m"], ["re", "im"], 1e-12)


def test_degree_511_round_trip(spark):
    """512 rings, 1024 columns, degrees to 511: coefficients come back through both transforms."""
    rng = np.random.default_rng(8)
    at = {(0, 0), (511, 511), (511, 0), (511, 200), (300, 299), *[(int(l), int(rng.integers(0, l + 1))) for l in rng.integers(1, 512, 40)]}
    rows = [("a", 0, l, m, float(rng.normal()), float(rng.normal()) if m else 0.0) for l, m in sorted(at)]
    q = spark.createDataFrame(rows, "field_id string, comp int, l int, m int, re double, im double")
    back = sp.sh_analysis(sp.sh_synthesis(q, 512, 1024, 511), 512, 1024, 511).toPandas()
    want = {r[2:4]: r[4] + 1j * r[5] for r in rows}
    got = back["re"] + 1j * back["im"]
    assert len(back) == 512 * 513 // 2
    assert max(abs(z - want.get((l, m), 0)) for z, l, m in zip(got, back["l"], back["m"])) < 1e-10


def test_unit_sphere_closed_form(spark):
    """The coordinates of the unit sphere have three known coefficients and rms radius 1."""
    g = sp.rings(spark, 6).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(11))))
    phi = F.lit(2 * math.pi) * F.col("j") / 12
    xyz = F.array(*[F.struct(F.lit(k).alias("comp"), v.alias("f")) for k, v in zip("xyz", (3 * F.col("st") * F.cos(phi) + 5, 3 * F.col("st") * F.sin(phi), 3 * F.col("ct")))])
    q = sp.sh_analysis(g.select(F.lit("s").alias("field_id"), "i", "j", F.inline(xyz)), 6, 12, 4)
    frame, normal = sp.parseval_normalise(q)
    r = frame.first()
    assert abs(r["scale"] - 3) < 1e-12 and abs(r["cx"] - 5) < 1e-12 and abs(r["cy"]) < 1e-12
    got = {(t["comp"], t["l"], t["m"]): (t["re"], t["im"]) for t in normal.collect()}
    assert abs(got["x", 1, 1][0] + math.sqrt(2 * math.pi / 3)) < 1e-12
    assert abs(got["y", 1, 1][1] - math.sqrt(2 * math.pi / 3)) < 1e-12
    assert abs(got["z", 1, 0][0] - math.sqrt(4 * math.pi / 3)) < 1e-12
    with pytest.raises(Exception, match="zero rms radius"):
        sp.parseval_normalise(q.withColumn("re", F.lit(0.0)).withColumn("im", F.lit(0.0)))[0].collect()


def test_sink_round_trip_and_refusal(spark, tmp_path):
    q = spectrum(spark)
    sinks.write_coeffs(q, str(tmp_path / "ok"), lmax=5, nlat=8, nphi=16)
    rows, prov = sinks.read_coeffs(spark, str(tmp_path / "ok"))
    close(rows.toPandas(), q.toPandas(), ["l", "m"], ["re", "im"], 0)
    assert prov.first()["nlat"] == 8
    with pytest.raises(ValueError):
        sinks.write_coeffs(q.where("l < 5"), str(tmp_path / "bad"), lmax=5, nlat=8, nphi=16)
