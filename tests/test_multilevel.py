"""The multilevel solver against dense solutions, its convergence on a mesh, and its signs of failure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbtable.operators import iterate as it, matrices as mx, multilevel as ml
from tests.test_spatial import sphere_mesh
from tests.test_supersteps import dense


def banded(spark, n, name="band"):
    rows = [(name, i, j, 4.2 if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1, i - 7, i + 7) if 0 <= j < n]
    return spark.createDataFrame(rows, "mesh_id string, row bigint, col bigint, val double").coalesce(2)


def test_one_task_and_levels_agree_with_numpy(spark):
    """A system that one task solves, one that goes down a level, an indefinite, a singular and an empty one, all in one job."""
    good = banded(spark, 120, "good")
    turned = good.withColumn("mesh_id", F.lit("indefinite")).withColumn("val", F.when(F.col("row") == F.col("col"), F.when(F.col("row") % 2 == 0, 4.2).otherwise(-4.2)).otherwise(F.col("val")))
    few = spark.createDataFrame([("pair", 0, 0, 1.0), ("pair", 1, 1, -1.0), ("zero", 0, 0, 0.0)], "mesh_id string, row bigint, col bigint, val double")
    matrix = good.unionByName(banded(spark, 20, "tiny")).unionByName(turned).unionByName(few).coalesce(2).cache()
    rhs = matrix.select("mesh_id", F.col("row").alias("v")).distinct().select("mesh_id", "v", F.sin(F.col("v") + 1).alias("b"), (1 + F.col("v") % 3).cast("double").alias("c"))
    got = ml.solve_systems(matrix, rhs, ["b", "c"], tol=1e-5, accept=1e-4, max_rounds=8, coarse=40).toPandas().sort_values(["mesh_id", "v"])
    assert set(got.mesh_id) == {"good", "indefinite", "pair", "tiny", "zero"}
    for name, n in (("good", 120), ("tiny", 20)):
        a, v, mine = dense(matrix.where(F.col("mesh_id") == name), n), np.arange(n), got[got.mesh_id == name]
        np.testing.assert_allclose(mine["b"], np.linalg.solve(a, np.sin(v + 1)), atol=2e-4)
        np.testing.assert_allclose(mine["c"], np.linalg.solve(a, 1.0 + v % 3), atol=2e-4)
    assert got[~got.mesh_id.isin(["good", "tiny"])][["b", "c"]].isna().all().all()


def test_levels_of_a_mesh(spark):
    """Groups cover a mesh and are about a seventh of it, constants go down exactly, and three rounds take the residual well down."""
    v, f, _ = sphere_mesh(spark, 16, 24, "ellipsoid")
    matrix = it._negated(mx.tutte_laplacian(f)).cache()
    groups = ml.group_neighbours(matrix)
    n = groups.agg(F.count("*"), F.count("c"), F.count_distinct("c")).first()
    assert n[0] == n[1] == v.count() and 4 < n[0] / n[2] < 12
    assert groups.where("v = c").count() == n[2]
    down = ml.interpolation(matrix, groups)
    assert down.groupBy("v").agg(F.sum("w").alias("w")).where("abs(w - 1) > 1e-12").count() == 0
    pins = F.col("row").isin(0, 1, 2) | F.col("col").isin(0, 1, 2)
    rhs = v.where("v > 2").select("mesh_id", "v", F.when(F.col("v") == 5, 1.0).when(F.col("v") == 11, -1.0).otherwise(0.0).alias("b"))
    out, rounds = ml.multilevel_pcg(matrix.where(~pins), rhs, ["b"], 1e-10, 3, coarse=60)
    assert rounds == 3 and out.agg(F.max("residual")).first()[0] < 0.05


def test_one_task_against_numpy():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 30))
    a = a @ a.T + 5 * np.eye(30)
    row, col = map(np.ravel, np.indices(a.shape))
    b = rng.normal(size=30)
    np.testing.assert_allclose(ml.pcg_arrays(row, col, a.ravel(), b), np.linalg.solve(a, b), rtol=1e-8)
    assert np.isnan(ml.pcg_arrays(row, col, -a.ravel(), b)).all() and not ml.pcg_arrays(row, col, a.ravel(), 0 * b).any()


def test_a_mesh_without_harmonic_map_gets_the_uniform_one(spark):
    """One mesh of two has a corner at infinity, so its cotangent system has no solution; it must not end up at the pole."""
    v, f, _ = sphere_mesh(spark, 4, 6)
    torn = v.select(F.lit("torn").alias("mesh_id"), "v", *[F.when(F.col("v") == 3, F.lit(float("inf"))).otherwise(F.col(c)).alias(c) for c in "xyz"])
    both, faces = v.unionByName(torn), f.unionByName(f.withColumn("mesh_id", F.lit("torn")))
    big = both.select("mesh_id").distinct().withColumn("f", F.lit(20).cast("bigint"))
    got = it.harmonic_map(both, faces, big).toPandas().sort_values(["mesh_id", "v"])
    want = it.tutte_map(v, f, big.where("mesh_id = 'm'")).toPandas().sort_values("v")
    np.testing.assert_allclose(got[got.mesh_id == "torn"][it.S], want[it.S], atol=1e-9)
    assert got[got.mesh_id == "m"][it.S].notna().all().all()


def test_a_system_that_is_not_solved_is_an_error(spark):
    matrix = banded(spark, 120).cache()
    rhs = matrix.select("mesh_id", F.col("row").alias("v")).distinct().select("mesh_id", "v", F.sin(F.col("v") + 1).alias("b"))
    with pytest.raises(ArithmeticError, match="not solved: band"):
        ml.solve_systems(matrix, rhs, ["b"], max_rounds=1, coarse=40)
    turned = matrix.withColumn("val", F.when(F.col("row") == F.col("col"), -4.2).otherwise(F.col("val")))
    assert ml.solve_systems(turned, rhs, ["b"]).where("isnan(b)").count() == 120
    with pytest.raises(ArithmeticError, match="not solved: band"):
        ml.solve_systems(turned, rhs, ["b"], whole=True)


def test_a_row_without_product_counts_as_missed(spark):
    """A right-hand side at an unknown that the matrix does not hold: nothing solves that row."""
    matrix = spark.createDataFrame([("m", 0, 0, 2.0)], "mesh_id string, row bigint, col bigint, val double")
    rhs = spark.createDataFrame([("m", 0, 1e-6), ("m", 1, 1.0)], "mesh_id string, v bigint, b double")
    assert ml.solve_systems(matrix, rhs, ["b"]).where("isnan(b)").count() == 2
