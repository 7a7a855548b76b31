"""How much of a plan moves: points and corners are made where they are used."""

import numpy as np
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.operators import faces as fo, mesh as mo, spectral as sp
from orbtable.plans import fit as fp


def random_coeffs(spark, lmax):
    rows = [(f"s{k}", c, l, m, float(np.sin(1 + k + 3 * l + 7 * m + ord(c))), 0.0 if m == 0 else float(np.cos(k + l + m))) for k in range(3) for c in "xyz" for l in range(lmax + 1) for m in range(l + 1)]
    return spark.createDataFrame(rows, "field_id string, comp string, l int, m int, re double, im double")


def test_filtered_points_are_made_after_the_last_shuffle(spark):
    """Few orders by sums and many by transforms of rings, both against the synthesis of single components."""
    gains = lambda lmax: spark.createDataFrame([("a", l, 1.0) for l in range(lmax + 1)] + [("b", l, 0.5 ** l) for l in range(lmax + 1)], "spec_id string, l int, g double")
    for nlat, nphi, lmax in ((5, 8, 3), (24, 48, 20)):
        q, g = random_coeffs(spark, lmax), gains(lmax)
        got = fp.filter_and_evaluate(q, g, nlat, nphi, lmax)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Aggregate")
        got = got.toPandas().set_index(["mesh_id", "spec_id", "i", "j"]).sort_index()
        assert len(got) == 3 * 2 * nlat * nphi
        one = sp.sh_synthesis(q.join(g.where("spec_id = 'b'"), "l").select("field_id", "comp", "l", "m", (F.col("re") * F.col("g")).alias("re"), (F.col("im") * F.col("g")).alias("im")), nlat, nphi, lmax)
        want = fp.as_points(one).toPandas().set_index(["mesh_id", "i", "j"]).sort_index()
        np.testing.assert_allclose(got.xs("b", level="spec_id")[list("xyz")], want[list("xyz")], atol=1e-12)
        grid = fp.as_points(sp.sh_synthesis(q, nlat, nphi, lmax)).select("mesh_id", "i", "j", *[(F.col(k) + F.sin("j")).alias(k) for k in "xyz"]).where("j <> 2")
        box = spark.createDataFrame([(f"s{k}", 0, 0.0, 0.0, 0.0) for k in range(3)] + [(f"s{k}", 1, 1.0, 2.0, 2.0) for k in range(3)], "mesh_id string, v int, x double, y double, z double")
        key = ["mesh_id", "spec_id"]
        got = fp.filter_residuals(q, g, grid, box, nlat, nphi, lmax).toPandas().sort_values(key)
        want = fp.residual_metrics(fp.filter_and_evaluate(q, g, nlat, nphi, lmax), grid, box).toPandas().sort_values(key)
        assert len(got) == 6
        np.testing.assert_allclose(got[["rms_pct", "max_pct"]], want[["rms_pct", "max_pct"]], rtol=1e-9)


def test_report_gathers_corners_once(spark, sf, monkeypatch):
    m = B.lineitem_meshes(spark, sf)
    frame = mo.charted_corners(m.faces, m.vertices, m.warped)
    settled, plain = [], fo.settle
    monkeypatch.setattr(fo, "settle", lambda df, label: settled.append(label) or plain(df, label))
    r = fo.chart_report(frame, crowded_at=30.0)
    assert "measured" in settled and "__spark" not in r._jdf.queryExecution().optimizedPlan().toString()
    assert "vertices" not in "".join(r.inputFiles())
    got = r.toPandas().set_index("mesh_id").sort_index()
    np.testing.assert_array_equal(got["folds"], fo.fold_count(frame).toPandas().set_index("mesh_id").sort_index()["folds"])
    np.testing.assert_allclose(got["spread"], fo.lambda_stats(frame).toPandas().set_index("mesh_id").sort_index()["spread"], rtol=1e-12)
