"""Small meshes are worked off inside a task; the joins for large ones give the same."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.operators import iterate as it, matrices as mx, mesh as mo, spatial as spt, spectral as sp
from orbtable.sources import generate as gen
from tests.test_spatial import soup, sphere_mesh


def jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "counted")
    out = run()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


@pytest.mark.parametrize("chart", ["chart", "warped"])
def test_warp_in_tasks_is_the_warp_by_joins(spark, sf, chart):
    """Also on charts with folds, where several faces hold a point; a few jobs do, however many rounds."""
    m = B.lineitem_meshes(spark, sf)
    one = lambda df: df.where("mesh_id = 's1'")
    v, f, c = one(m.vertices), one(m.faces), one(getattr(m, chart))
    cfg = c.select("mesh_id").distinct().select("mesh_id", F.lit(4).alias("nlat"), F.lit(6).alias("nphi"))
    grid, dirs = gen.tensor_faces(cfg), gen.tensor_vertices(cfg, sp.rings_for(cfg))
    rows = lambda df: df.toPandas().sort_values(["mesh_id", "v"])
    want, many = jobs(spark, lambda: rows(it.adaptive_warp(v, f, c, grid, dirs, 2, small=0)))
    got, n = jobs(spark, lambda: rows(it.adaptive_warp(v, f, c, grid, dirs, 2)))
    assert len(got) == 26 and (got.v.to_numpy() == want.v.to_numpy()).all() and 2 * n < many
    np.testing.assert_allclose(got[list("xyz")], want[list("xyz")], atol=1e-9)


def test_pcg_in_tasks_is_the_pcg_by_joins(spark):
    """With a start, a second right-hand side, a zero one and a zero on a diagonal; a few jobs do, however many rounds."""
    v, f, chart = sphere_mesh(spark, 3, 5, "ellipsoid")
    mat = mx.mass_plus_laplacian(mo.charted_corners(f, v, chart), 0.5)
    mat = mat.unionByName(mat.select(F.lit("hole").alias("mesh_id"), "row", "col", F.when((F.col("row") == 4) & (F.col("col") == 4), 0.0).otherwise(F.col("val")).alias("val"))).cache()
    ids = mat.select("mesh_id", F.col("row").alias("v")).distinct()
    rhs = ids.select("mesh_id", "v", F.sin(F.col("v")).alias("b"), F.lit(0.0).alias("c"))
    start = ids.select("mesh_id", "v", F.cos(F.col("v")).alias("b"), F.lit(0.0).alias("c"))
    rows = lambda df: df.toPandas().sort_values(["mesh_id", "comp", "v"])
    for begin in (None, start):
        want, many = jobs(spark, lambda: rows(it.jacobi_pcg(mat, rhs, ["b", "c"], 1e-9, 3, begin, small=0)))
        got, n = jobs(spark, lambda: rows(it.jacobi_pcg(mat, rhs, ["b", "c"], 1e-9, 3, begin)))
        assert len(got) == len(want) == 68 and 2 * n < many
        for c in ("x", "residual"):
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12)


def test_pairs_in_tasks_are_the_pairs_by_cells(spark):
    """Soups of crossing triangles, one with repeated faces and one with a collapsed triangle; no pair of a small mesh moves."""
    xyz = soup(90, 7)
    xyz[3:6] = xyz[3]
    v = spark.createDataFrame(pd.DataFrame({"mesh_id": "m", "v": np.arange(270), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))
    f = spark.createDataFrame(pd.DataFrame({"mesh_id": "m", "f": np.arange(90), "a": np.arange(0, 270, 3), "b": np.arange(1, 270, 3), "c": np.arange(2, 270, 3)}))
    part = f.where("f < 60").withColumn("mesh_id", F.lit("n"))
    both = f.unionByName(part).unionByName(part.withColumn("f", F.col("f") + 100))
    places = v.unionByName(v.withColumn("mesh_id", F.lit("n")))
    out = spt.self_intersections(places, both)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(out)
    assert got == rows(spt.self_intersections(places, both, small=0)) == rows(spt.self_intersections(places, both, small=100))
    assert got[0][1] and got[1][1] and "FlatMapGroupsInPandas" in plan and "pf" not in plan
