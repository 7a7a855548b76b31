import numpy as np
import pytest
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.operators import faces as fo, iterate as it, matrices as mx, mesh as mo


def volumes(tri, s):
    a, b, c = s[tri[:, 0]], s[tri[:, 1]], s[tri[:, 2]]
    return np.einsum("ij,ij->i", a, np.cross(b, c))


def bad_faces(tri, s):
    sg = np.sign(volumes(tri, s))
    return np.flatnonzero(sg != (1 if 2 * (sg > 0).sum() >= len(tri) else -1))


def brute_repair(tri, s, most):
    """Whole meshes in numpy: (positions, passes, folds left)."""
    n = len(s)
    adj = np.zeros((n, n), bool)
    for a, b, c in tri:
        adj[[a, b, b, c, c, a], [b, a, c, b, a, c]] = True
    passes = 0
    while True:
        bad = bad_faces(tri, s)
        if len(bad) == 0 or passes == most:
            return s, passes, len(bad)
        touch = np.zeros(n, bool)
        touch[tri[bad].ravel()] = True
        grown = touch | adj[touch].any(0)
        mean = adj @ s
        s = np.where(grown[:, None], mean / np.linalg.norm(mean, axis=1, keepdims=True), s)
        passes += 1


def arrays(faces, chart):
    f = faces.toPandas().sort_values("f")[["a", "b", "c"]].to_numpy()
    return f, chart.toPandas().sort_values("v")[["sx", "sy", "sz"]].to_numpy()


def picked(spark, sf, ids):
    m = B.lineitem_meshes(spark, sf)
    pick = lambda df: df.where(F.col("mesh_id").isin(*ids))
    return pick(m.vertices), pick(m.faces), pick(m.chart), pick(m.warped)


def test_frontier_repair_equals_whole_passes(spark, sf):
    """Three meshes of different needs together, each as if it were alone; one has no fold at all."""
    v, f, chart, warped = picked(spark, sf, ["s1", "s2", "s3"])
    start = warped.where("mesh_id <> 's3'").select("mesh_id", "v", *it.S).unionByName(chart.where("mesh_id = 's3'").select("mesh_id", "v", *it.S))
    got, passes, bad, n = it.repair_rounds(f, start, 12)
    most = 0
    for mesh in ("s1", "s2", "s3"):
        one = lambda df: df.where(F.col("mesh_id") == mesh)
        tri, s = arrays(one(f), one(start))
        want, k, left = brute_repair(tri, s, 12)
        most = max(most, k)
        np.testing.assert_allclose(arrays(one(f), one(got))[1], want, atol=1e-9)
        assert one(bad).count() == left
    assert passes == most and n == bad.count()


def test_majority_that_turns_during_repair(spark):
    """An octahedron with most faces turned by one displaced corner: judged again as a whole once the majority is back."""
    tri = [(4, 0, 1), (4, 1, 2), (4, 2, 3), (4, 3, 0), (5, 1, 0), (5, 2, 1), (5, 3, 2), (5, 0, 3)]
    rng = np.random.default_rng(1)
    turned = 0
    for _ in range(200):
        s = rng.normal(size=(6, 3))
        s /= np.linalg.norm(s, axis=1, keepdims=True)
        t = np.array(tri)
        before, after = np.sign(volumes(t, s)), np.sign(volumes(t, brute_repair(t, s, 1)[0]))
        if len(bad_faces(t, s)) and (2 * (before > 0).sum() >= 8) != (2 * (after > 0).sum() >= 8):
            turned = 1
            break
    assert turned
    faces = spark.createDataFrame([("o", k, *map(int, x)) for k, x in enumerate(tri)], "mesh_id string, f bigint, a bigint, b bigint, c bigint")
    chart = spark.createDataFrame([("o", k, *map(float, x)) for k, x in enumerate(s)], "mesh_id string, v bigint, sx double, sy double, sz double")
    got, passes, bad, n = it.repair_rounds(faces, chart, 3)
    want, k, left = brute_repair(np.array(tri), s, 3)
    np.testing.assert_allclose(arrays(faces, got)[1], want, atol=1e-9)
    assert (passes, n) == (k, left)


@pytest.mark.parametrize("mend, taken, mended", [(0, 1, 0), (2, 0, 1)])
def test_flow_takes_the_first_candidate_that_can_be_mended(spark, sf, mend, taken, mended):
    """Three spikes make the whole step fold: it is halved where no repair is allowed, and mended in one pass otherwise."""
    v, f, chart, _ = picked(spark, sf, ["s1"])
    far = F.when(F.col("v").isin(40, 41, 70), 60.0).otherwise(1.0)
    v = v.select("mesh_id", "v", *[(F.col(k) * far).alias(k) for k in "xyz"])
    dt = 0.01
    got, log = it.density_equalise(v, f, chart, dt=dt, max_steps=1, mend_passes=mend)
    fr = mo.charted_corners(f, v, chart)
    rho0 = fo.vertex_population_density(fr)
    rhs = rho0.join(mx.lumped_mass(fr), ["mesh_id", "v"]).select("mesh_id", "v", (F.col("rho") * F.col("m")).alias("rho"))
    vel = fo.density_velocity(fr, it.solve_systems(mx.mass_plus_laplacian(fr, dt), rhs, ["rho"], 1e-6))
    d = vel.toPandas().sort_values("v")[["dx", "dy", "dz"]].to_numpy()
    tri, s = arrays(f, chart)
    pairs = np.vstack([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
    e = np.full(len(s), np.inf)
    for col in (0, 1):
        np.minimum.at(e, pairs[:, col], np.linalg.norm(s[pairs[:, 0]] - s[pairs[:, 1]], axis=1))
    length = dt * np.linalg.norm(d, axis=1)
    tries = [dt / 2**h * d for h in range(9)]
    tries += [dt * d * np.where(length > c * e, c * e / np.where(length > 0, length, 1), 1)[:, None] for c in (0.3 / 2**h for h in range(5))]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for h, move in enumerate(tries):
        cand, passes, left = brute_repair(tri, unit(s + move), mend)
        if left == 0:
            break
    assert (h, passes) == (taken, mended)
    np.testing.assert_allclose(arrays(f, got)[1], cand, atol=1e-6)
    assert [r["step"] for r in log.orderBy("step").collect()] == [0, 1]
    if mend:
        for h in (9, 13):
            capped = it._candidate(chart.select("mesh_id", "v", *it.S), vel, it._shortest_edges(fr), dt, h)
            np.testing.assert_allclose(arrays(f, capped)[1], unit(s + tries[h]), atol=1e-6)


def test_an_even_surface_leaves_at_once(spark, sf):
    v, f, chart, _ = picked(spark, sf, ["s1"])
    even = chart.select("mesh_id", "v", *[F.col("s" + k).alias(k) for k in "xyz"])
    got, log = it.density_equalise(even, f, chart, max_steps=3)
    assert [(r["step"], r["stopped"]) for r in log.collect()] == [(0, "converged")]
    assert got.count() == chart.count()
