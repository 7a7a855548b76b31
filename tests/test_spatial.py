import numpy as np
import pandas as pd

from orbtable.operators import spatial as spt, surface as su
from orbtable.plans import fit as fp
from orbtable.sources import generate
from pyspark.sql import functions as F


def cloud(spark, xyz):
    return spark.createDataFrame(pd.DataFrame({"cloud_id": "c", "p": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))


def brute(xyz, k):
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    return np.stack([np.lexsort((np.arange(len(xyz)), np.round(row, 15)))[:k] for row in d])


def test_knn_on_a_dense_spot_copies_and_far_points(spark):
    rng = np.random.default_rng(3)
    xyz = np.vstack([rng.random((60, 3)), 0.5 + 1e-4 * rng.random((120, 3)), np.tile([[0.2, 0.3, 0.4]], (90, 1)), [[9, 9, 9], [-8, 0, 0]]])
    got = spt.knn_join(cloud(spark, xyz), 6).toPandas().sort_values(["p", "rank"])
    assert (got["q"].to_numpy().reshape(len(xyz), 6) == brute(xyz, 6)).all()


def test_knn_of_fewer_points_than_k(spark):
    assert spt.knn_join(cloud(spark, np.eye(3)), 5).count() == 9


def soup(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.random((n, 1, 3))
    return (base + 0.2 * (rng.random((n, 3, 3)) - 0.5)).reshape(-1, 3)


def crosses(p, q, t):
    n = np.cross(t[1] - t[0], t[2] - t[0])
    d0, d1 = n @ (p - t[0]), n @ (q - t[0])
    if d0 * d1 >= 0:
        return False
    x = p + d0 / (d0 - d1) * (q - p)
    return all(np.cross(t[(i + 1) % 3] - t[i], x - t[i]) @ n >= 0 for i in range(3))


def hits(a, b):
    return any(crosses(a[i], a[(i + 1) % 3], b) or crosses(b[i], b[(i + 1) % 3], a) for i in range(3))


def test_self_intersections_equal_brute_force(spark):
    n = 120
    xyz = soup(n, 5)
    tri = xyz.reshape(n, 3, 3)
    want = sum(hits(tri[i], tri[j]) for i in range(n) for j in range(i))
    v = spark.createDataFrame(pd.DataFrame({"mesh_id": "m", "v": np.arange(3 * n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))
    f = spark.createDataFrame(pd.DataFrame({"mesh_id": "m", "f": np.arange(n), "a": np.arange(0, 3 * n, 3), "b": np.arange(1, 3 * n, 3), "c": np.arange(2, 3 * n, 3)}))
    assert want > 0 and spt.self_intersections(v, f).first()["pairs"] == want
    # every face twice: copies do not meet each other, other pairs count four times
    twice = f.unionByName(f.withColumn("f", F.col("f") + n))
    assert spt.self_intersections(v, twice).first()["pairs"] == 4 * want


def sphere_mesh(spark, nlat=12, nphi=17, kind="sphere"):
    cfg = spark.createDataFrame([("m", nlat, nphi, kind)], "mesh_id string, nlat int, nphi int, kind string")
    v, f = generate.latlong_mesh(cfg)
    return v.select("mesh_id", "v", "x", "y", "z"), f, v.select("mesh_id", "v", "sx", "sy", "sz")


def test_sphere_mesh_is_embedded_and_locates_everything(spark):
    v, f, chart = sphere_mesh(spark)
    assert spt.self_intersections(v, f).first()["pairs"] == 0
    rng = np.random.default_rng(2)
    d = rng.normal(size=(400, 3))
    ask = spark.createDataFrame(pd.DataFrame({"mesh_id": "m", "q": np.arange(400), "x": d[:, 0], "y": d[:, 1], "z": d[:, 2]}))
    full = spt.locate(f, chart, ask).toPandas().set_index("q").sort_index()
    fast = spt.locate(f, chart, ask, label=False).toPandas().set_index("q").sort_index()
    assert len(full) == len(fast) == 400 and (full["f"] == fast["f"]).all()
    assert full["how"].isin(["vertex", "ring"]).mean() > 0.99
    pts = spt.pl_interpolate(spt.locate(f, chart, ask, label=False), v, ["x", "y", "z"]).toPandas().sort_values("q")[["x", "y", "z"]].to_numpy()
    u = d / np.linalg.norm(d, axis=1)[:, None]
    assert np.abs(pts - u).max() < 0.06


def test_limit_sampling_converges_and_curvature_of_the_sphere(spark):
    v, f, chart = sphere_mesh(spark, 10, 16)
    grid, q = fp.fit(v, f, chart, 12, 24, 5)
    k = fp.pointwise_curvature(fp.derivative_fields(q, 12, 24, 5), 12)
    e = fp.curvature_error(k).first()
    assert e["rms"] < 0.1
    s = su.limit_sampling(v, f, chart, fp.grid_directions(chart, 4, 8), 1).toPandas()
    r = np.sqrt((s[["x", "y", "z"]] ** 2).sum(axis=1))
    assert len(s) == 32 and r.std() < 0.02
