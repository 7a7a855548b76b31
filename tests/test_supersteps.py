import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.operators import cloud as cl, faces as fo, iterate as it, matrices as mx, mesh as mo
from orbtable.operators.spatial import knn_join
from orbtable.sources import generate
from tests.test_spatial import sphere_mesh


def dense(m, n):
    a = np.zeros((n, n))
    for r in m.collect():
        a[r["row"], r["col"]] += r["val"]
    return a


def test_pcg_and_dense_route_agree_with_numpy(spark):
    v, f, chart = sphere_mesh(spark, 3, 5, "ellipsoid")
    fr = mo.charted_corners(f, v, chart)
    mat = mx.mass_plus_laplacian(fr, 0.5)
    want = np.linalg.solve(dense(mat, 17), np.arange(17.0))
    rhs = v.select("mesh_id", "v", F.col("v").cast("double").alias("b"))
    got = it.jacobi_pcg(mat, rhs, ["b"], 1e-10, 30).toPandas().sort_values("v")
    np.testing.assert_allclose(got["x"], want, rtol=1e-7)
    assert got["residual"].max() <= 1e-10
    small = it.solve_systems(mat, rhs, ["b"]).toPandas().sort_values("v")
    np.testing.assert_allclose(small["b"], want, rtol=1e-9)


def test_repair_removes_every_fold_and_tutte_map_is_valid(spark, sf):
    m = B.lineitem_meshes(spark, sf)
    one = lambda df: df.where("mesh_id = 's1'")
    faces, v = one(m.faces), one(m.vertices)
    assert fo.fold_count(it.chart_corners(faces, one(m.warped))).first()["folds"] > 0
    fixed, _ = it.repair_folds(faces, one(m.warped), 60)
    assert fo.fold_count(it.chart_corners(faces, fixed)).first()["folds"] == 0
    big = fo.most_regular_triangle(mo.face_corners(faces, v, ["x", "y", "z"]))
    t = it.tutte_map(v, faces, big)
    assert fo.fold_count(it.chart_corners(faces, t)).first()["folds"] == 0
    assert t.agg(F.max(F.abs(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2 - 1)).alias("e")).first()["e"] < 1e-12


def test_clouds_on_the_golden_spiral(spark):
    cfg = spark.createDataFrame([("g", 300)], "cloud_id string, n int")
    p = generate.golden_spiral(cfg)
    unit = p.select("cloud_id", "p", *[(F.col(c) / F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias(c) for c in "xyz"])
    knn = knn_join(unit, 16)
    lap = cl.mls_laplacian(unit, knn)
    z = lap.join(unit.select("cloud_id", F.col("p").alias("col"), "z"), ["cloud_id", "col"]).groupBy("row").agg(F.sum(F.col("val") * F.col("z")).alias("lz"))
    err = z.join(unit.select(F.col("p").alias("row"), "z"), "row").select(F.abs(F.col("lz") + 2 * F.col("z")).alias("e")).agg(F.max("e")).first()[0]
    assert err < 0.15  # the Laplacian of a coordinate on the unit sphere is -2 times it
    normals = cl.pca_frame(unit, knn).join(unit, ["cloud_id", "p"]).select(F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")).alias("c"))
    assert normals.agg(F.min("c")).first()[0] > 0.98
    share = cl.mesh_share(cl.local_delaunay_ring(unit, knn), unit).first()
    assert share["share"] > 0.97 and share["nf"] <= 2 * 300 - 4
