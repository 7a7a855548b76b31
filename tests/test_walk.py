import numpy as np
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.operators import spatial as spt, walk
from orbtable.operators.mesh import face_corners
from tests.test_spatial import sphere_mesh


def asked(spark, mesh_ids, n, nf, seed=5):
    """Random directions with random faces to start from; some start nowhere or at a face that is not there."""
    rng = np.random.default_rng(seed)
    rows = []
    for mesh in mesh_ids:
        p = rng.normal(size=(n, 3))
        for k, (x, y, z) in enumerate(p):
            start = None if k % 17 == 0 else 10**9 if k % 19 == 0 else int(rng.integers(nf))
            rows.append((mesh, k, float(x), float(y), float(z), start))
    return spark.createDataFrame(rows, "mesh_id string, q bigint, x double, y double, z double, f bigint")


def same(spark, v, f, chart, queries, steps):
    got = walk.locate_from(f, chart, walk.face_patches(f, chart), queries, steps).toPandas().sort_values(["mesh_id", "q"])
    want = spt.locate(f, chart, queries.drop("f"), label=False).toPandas().sort_values(["mesh_id", "q"])
    assert got[["mesh_id", "q", "f"]].values.tolist() == want[["mesh_id", "q", "f"]].values.tolist()
    w = ["w0", "w1", "w2"]
    np.testing.assert_allclose(got[w].astype(float), want[w].astype(float), atol=1e-9)
    return got


def test_walks_from_anywhere_end_where_a_full_search_ends(spark):
    v, f, chart = sphere_mesh(spark, 9, 14, "ellipsoid")
    q = asked(spark, [chart.first()["mesh_id"]], 200, f.count())
    assert len(same(spark, v, f, chart, q, 30)) == 200
    assert len(same(spark, v, f, chart, q, 1)) == 200  # most walks are cut short and finished by the full search


def test_folded_charts_are_searched_in_full(spark, sf):
    m = B.lineitem_meshes(spark, sf)
    pick = lambda df: df.where("mesh_id IN ('s1', 's2')")
    f, warped = pick(m.faces), pick(m.warped)
    assert walk.face_patches(f, warped).count() == 0
    assert walk.face_patches(f, pick(m.chart)).groupBy("mesh_id").count().count() == 2
    same(spark, pick(m.vertices), f, warped, asked(spark, ["s1", "s2"], 60, 200), 8)


def test_a_patch_is_a_face_and_those_across_its_edges(spark):
    v, f, chart = sphere_mesh(spark, 4, 6, "ellipsoid")
    tri = {r["f"]: {r["a"], r["b"], r["c"]} for r in f.collect()}
    for r in walk.face_patches(f, chart).collect():
        want = {g for g, t in tri.items() if len(t & tri[r["f"]]) >= 2}
        assert {n["t"] for n in r["near"]} == want and len(r["near"]) == 4


def test_a_chart_that_covers_the_sphere_twice_is_not_single(spark):
    v, f, chart = sphere_mesh(spark, 4, 6, "ellipsoid")
    twice = f.unionByName(f.withColumn("f", F.col("f") + 1000))
    frame = lambda faces: face_corners(faces, chart, ["sx", "sy", "sz"])
    assert walk.single_sheet(frame(f)).count() == 1
    assert walk.single_sheet(frame(twice)).count() == 0


def test_no_rows_to_walk(spark):
    v, f, chart = sphere_mesh(spark, 4, 6, "ellipsoid")
    q = asked(spark, [chart.first()["mesh_id"]], 4, 10).where("false")
    assert walk.locate_from(f, chart, walk.face_patches(f, chart), q).count() == 0
