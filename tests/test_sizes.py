"""What the planner believes of intermediate tables."""

from pyspark.sql import functions as F

from orbtable.operators.mesh import face_corners
from orbtable.session import dimension, settle


def planned_bytes(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def repetitive(spark, meshes=2_000):
    """Faces as Parquet dictionaries like them: a few hundred numbers, over and over."""
    return spark.range(meshes * 208, numPartitions=2).select(
        F.concat(F.lit("s"), (F.col("id") / 208).cast("int").cast("string")).alias("mesh_id"), (F.col("id") % 208).alias("f"),
        *[(F.col("id") % n).alias(c) for c, n in zip("abc", (101, 103, 106))])


def test_settled_table_is_planned_at_the_size_of_its_rows(spark):
    rows = repetitive(spark)
    least = rows.count() * 4 * 8
    assert planned_bytes(settle(rows)) >= least
    assert planned_bytes(dimension(spark, ("sizes", "test"), lambda: rows)) >= least


def test_large_repetitive_tables_are_not_broadcast(spark):
    faces = settle(repetitive(spark, 5_000))
    verts = settle(faces.select("mesh_id", F.col("a").alias("v"), *[F.lit(1.0).alias(k) for k in "xyz"]).distinct())
    out = face_corners(faces, verts, ["x", "y", "z"])
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()


def test_icosphere_rounds_start_from_tables_of_known_size(spark, monkeypatch):
    from orbtable.sources import generate as gen

    seen, plain = [], gen.numbered_edges
    monkeypatch.setattr(gen, "numbered_edges", lambda f, v: seen.extend([planned_bytes(f), planned_bytes(v)]) or plain(f, v))
    configs = spark.range(500, numPartitions=2).select(F.col("id").cast("string").alias("mesh_id"), F.lit(1).alias("subdiv"))
    gen.icosphere(configs)
    assert seen[0] >= 500 * 20 * 4 * 8 and seen[1] >= 500 * 12 * 4 * 8


def test_overlap_of_triangle_sets_moves_every_triangle_once(spark):
    from orbtable.operators.mesh import triangle_set_overlap

    one = spark.createDataFrame([("m", 0, 1, 2), ("m", 2, 0, 1), ("m", 1, 2, 3), ("n", 0, 1, None)], "mesh_id string, a long, b long, c long")
    two = spark.createDataFrame([("m", 1, 0, 2), ("m", 4, 5, 6), ("n", 0, 1, None), ("n", 0, 1, 1)], "mesh_id string, a long, b long, c long")
    out = triangle_set_overlap(one, two)
    assert sorted(map(tuple, out.collect())) == [("m", 1, 2, 2, 0.5), ("n", 1, 1, 2, 0.5)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 2


def test_specs_of_a_small_file_are_dealt_to_all_tasks(spark, sf):
    from orbtable.catalog import QUERIES, load
    from orbtable.catalog.fields import part_specs

    load()
    assert part_specs(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = QUERIES["gain_join"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in joined


def test_symmetric_matrices_are_summed_by_one_half(spark):
    from orbtable.operators import matrices as mx

    faces = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 2, 1, 3), ("n", 0, 5, 5, 4)], "mesh_id string, f long, a long, b long, c long")
    want = {}
    for m, _, a, b, c in faces.collect():
        for u, w in ((a, b), (b, c), (c, a)):
            for r, k, x in ((u, w, 0.5), (w, u, 0.5), (u, u, -0.5), (w, w, -0.5)):
                want[m, r, k] = want.get((m, r, k), 0.0) + x
    out = mx.tutte_laplacian(faces)
    assert sorted(map(tuple, out.collect())) == sorted((*k, v) for k, v in want.items())
    raw = mx._edge_matrix(faces, *[F.lit(0.5)] * 3)
    assert raw.count() == 6 * faces.count() and not raw.where("row > col").count()


def first_aggregation(df):
    """The plan from the first aggregation down."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[plan.rindex("Aggregate"):]


def test_both_directions_of_an_edge_meet_as_one(spark):
    from orbtable.operators import mesh as mo

    faces = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 2, 1, 3), ("n", 0, 5, 5, 4)], "mesh_id string, f long, a long, b long, c long")
    out = mo.undirected(mo.half_edges(faces), "u", "w")
    want = {(m, *e) for m, _, a, b, c in faces.collect() for u, w in ((a, b), (b, c), (c, a)) for e in ((u, w), (w, u))}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "least" in first_aggregation(out)


def test_both_directions_of_a_ring_meet_as_one(spark):
    from orbtable.operators import cloud as cl

    rings = spark.createDataFrame([("k", 1, 1, 2, 3), ("k", 2, 2, 1, 3), ("k", 2, 2, 3, 4), ("k", 3, 3, None, 3)], "cloud_id string, p long, a long, b long, c long")
    out = cl.ring_minus_self(rings)
    assert sorted(map(tuple, out.collect())) == [("k", 1, 2), ("k", 1, 3), ("k", 2, 1), ("k", 2, 3), ("k", 2, 4)]
    assert "least" in first_aggregation(out)
