"""Triangulation of the sphere against every circle of three points, and against its closed form."""

import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from orbtable.operators import stars


def table(spark, clouds):
    rows = [(name, int(i), *map(float, x)) for name, pts in clouds.items() for i, x in pts]
    return spark.createDataFrame(rows, "cloud_id string, p long, x double, y double, z double")


def brute_hull(pts):
    """Triples whose plane has all other points on one side, outward, smallest id first."""
    ids, x = zip(*pts)
    x = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for a, b, c in itertools.combinations(range(len(x)), 3):
        normal = np.cross(x[b] - x[a], x[c] - x[a])
        side = np.delete((x - x[a]) @ normal, [a, b, c])
        if (side < 0).all():
            t = (ids[a], ids[b], ids[c])
        elif (side > 0).all():
            t = (ids[a], ids[c], ids[b])
        else:
            continue
        k = t.index(min(t))
        out.add(t[k:] + t[:k])
    return out


def meshed(spark, clouds, **more):
    got = defaultdict(set)
    for r in stars.sphere_mesh(table(spark, clouds), **more).collect():
        got[r["cloud_id"]].add((r["a"], r["b"], r["c"]))
    return got


def test_hulls(spark):
    rng = np.random.default_rng(5)
    ball = lambda n: rng.normal(size=(n, 3))
    two = np.vstack([ball(25) * 0.02 + [0, 0, 1], ball(25) * 0.02 + [1, 0, -1]])  # far apart clusters
    cap = ball(30) * 0.1 + [0, 1, 0]  # all on one side
    clouds = {"ball": ball(60), "two": two, "cap": cap, "four": ball(4), "three": ball(3), "one": ball(1)}
    clouds = {name: list(zip(rng.permutation(1000)[:len(x)] * 7, x)) for name, x in clouds.items()}
    got = meshed(spark, clouds, k=6)
    assert set(got) == {"ball", "two", "cap", "four"}
    for name in got:
        assert got[name] == brute_hull(clouds[name]), name
        assert len(got[name]) == 2 * len(clouds[name]) - 4


def test_copies_grids_and_hubs(spark):
    """Points in one direction, points on common circles, and a point that is everyone's neighbour."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    copies = [*enumerate(x), *[(100 + i, 3 * v) for i, v in enumerate(x[:10])], (500, np.zeros(3))]
    t, f = np.meshgrid(np.arange(1, 8) * np.pi / 8, np.arange(16) * np.pi / 8)
    grid = np.stack([np.sin(t) * np.cos(f), np.sin(t) * np.sin(f), np.cos(t)], -1).reshape(-1, 3)
    grid = list(enumerate([*grid, (0, 0, 1), (0, 0, -1)]))
    ring = np.arange(200) * 2 * np.pi / 200
    hub = [(0, (0, 0, 1)), (1, (0, 0, -1)), *[(2 + i, (np.cos(a), np.sin(a), 0.01 * np.sin(7 * a))) for i, a in enumerate(ring)]]
    df = table(spark, {"copies": copies, "grid": grid, "hub": hub})
    faces = stars.sphere_mesh(df).cache()
    got = {r["cloud_id"]: (r["n"], r["nf"], r["euler"]) for r in stars.closure(df, faces).collect()}
    assert got == {"copies": (40, 76, 2), "grid": (114, 224, 2), "hub": (202, 400, 2)}
    assert not faces.where("cloud_id = 'copies' AND (c >= 100 OR b >= 100)").count()
    assert brute_hull(copies[:40]) == {tuple(r)[1:] for r in faces.where("cloud_id = 'copies'").collect()}
    assert stars.sphere_mesh(df.limit(0)).count() == 0


def test_large_cloud(spark):
    """A closed mesh of 20,000 points, every edge in two faces."""
    n = 20_000
    g = np.pi * (3 - 5 ** 0.5)
    df = spark.range(n).select(F.lit("spiral").alias("cloud_id"), F.col("id").alias("p"), ((F.col("id") + 0.5) * 2 / n - 1).alias("z"), (F.col("id") * g).alias("t"))
    r = F.sqrt(1 - F.col("z") * F.col("z"))
    df = df.select("cloud_id", "p", (r * F.cos("t")).alias("x"), (r * F.sin("t")).alias("y"), "z")
    got = stars.closure(df, stars.sphere_mesh(df)).first()
    assert (got["n"], got["nf"], got["euler"]) == (n, 2 * n - 4, 2)


def test_stars_pass_python_in_small_batches(spark, monkeypatch):
    name, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], stars.settle
    before = spark.conf.get(name)
    monkeypatch.setattr(stars, "settle", lambda df, label="step": seen.append((label, int(spark.conf.get(name)))) or plain(df, label))
    pts = list(enumerate(np.random.default_rng(5).normal(size=(12, 3))))
    faces = stars.sphere_mesh(table(spark, {"k": pts}), 6).collect()
    assert {(f["a"], f["b"], f["c"]) for f in faces} == brute_hull(pts)
    assert {n for label, n in seen if label == "splay"} == {1000} and spark.conf.get(name) == before
