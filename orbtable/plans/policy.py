"""Choosing a chart per mesh: conformal where it is not crowded, area-equalised elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbtable.functions import geometry as g
from orbtable.functions.vec import named, vec
from orbtable.operators import faces as fo, iterate as it
from orbtable.operators.mesh import charted_corners, face_corners
from orbtable.session import settle

# fixed value: a chart whose lambda ratio exceeds this is crowded
CROWDED = 1e4
SMOOTHING_ROUNDS = 2


def mobius_apply_best(frame: DataFrame, chart: DataFrame, params: DataFrame) -> DataFrame:
    """The chart moved by each mesh's best candidate map."""
    best = fo.mobius_best(fo.mobius_objective(frame, params)).join(F.broadcast(params), "param_id").drop("obj", "param_id")
    k = [F.col(f"k{i}") for i in range(8)]
    u, w = g.stereo_north(vec("s"))
    pole = F.abs(1 - F.col("sz")) < 1e-15
    plane = chart.join(best, "mesh_id").select("mesh_id", "v", *named(vec("s"), "s"), *[c.alias(n) for c, n in zip(g.mobius(u, w, k), "pq")])
    up = g.unstereo(F.col("p"), F.col("q"))
    return plane.select(
        "mesh_id", "v", *[F.when(pole, F.col("s" + c)).otherwise(x).alias("s" + c) for c, x in zip("xyz", up)])


def map_policy(vertices: DataFrame, faces: DataFrame, params: DataFrame, max_ratio: float = CROWDED,
               max_steps: int = 300) -> tuple[DataFrame, DataFrame]:
    """(chart, report). The branch is taken per mesh by semi- and anti-joins, not by the driver.

    steps, flow_spread and stopped are those of the area flow ('max steps' where only the cap ended it), NULL elsewhere.
    """
    frame = face_corners(faces, vertices, ["x", "y", "z"])
    big = settle(fo.most_regular_triangle(frame), "puncture")
    conf = settle(it.qc_correct(vertices, faces, it.harmonic_map(vertices, faces, big)), "conformal")
    conf = settle(mobius_apply_best(charted_corners(faces, vertices, conf), conf, params), "conformal")
    stats = fo.lambda_stats(charted_corners(faces, vertices, conf))
    crowded = settle(stats.where(~(F.col("ratio") <= max_ratio)).select("mesh_id"), "crowded")
    chart = conf.join(crowded, "mesh_id", "leftanti")
    flow = crowded.select("mesh_id", F.lit(None).cast("int").alias("steps"), F.lit(None).cast("double").alias("flow_spread"), F.lit(None).cast("string").alias("stopped"))
    if crowded.limit(1).count():
        pick = lambda df: settle(df.join(crowded, "mesh_id", "leftsemi"), "crowded")
        v, f, b = pick(vertices), pick(faces), pick(big)
        area, log = it.density_equalise(v, f, it.tutte_map(v, f, b), max_steps=max_steps)
        last = log.groupBy("mesh_id").agg(F.max(F.struct("step", "spread", "stopped")).alias("m"))
        flow = settle(last.select("mesh_id", F.col("m.step").alias("steps"), F.col("m.spread").alias("flow_spread"),
                                  F.coalesce("m.stopped", F.lit("max steps")).alias("stopped")), "flow-report")
        chart = chart.unionByName(it.smooth_chart(f, area, SMOOTHING_ROUNDS))
    before = fo.fold_count(charted_corners(faces, vertices, chart)).withColumnRenamed("folds", "folds_repaired")
    chart, _ = it.repair_folds(faces, settle(chart, "chart"))
    report = fo.chart_report(charted_corners(faces, vertices, chart), "conformal + Moebius").join(before, "mesh_id").join(
        crowded.withColumn("area", F.lit(True)), "mesh_id", "left").join(flow, "mesh_id", "left")
    label = F.when(F.col("area"), F.lit("area-equalised")).otherwise(F.col("type"))
    return chart, report.withColumn("type", label).withColumn("crowded", F.col("area").isNotNull()).drop("area")
