"""How the given tables become surfaces, fields and clouds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.functions.libm import sin_cos
from orbtable.functions.vec import named, scale
from orbtable.session import dimension
from orbtable.sources.generate import latlong_faces, latlong_vertices

# sphere field from events
E_NLAT, E_NPHI, E_LMAX = 12, 32, 5
# radial meshes from lineitem: one mesh per supplier
L_NLAT, L_NPHI, L_WARP = 8, 13, 1.5707


@dataclass
class Meshes:
    """vertices(mesh_id, v, x, y, z), faces, the exact chart and a warped, partly folded chart."""

    vertices: DataFrame
    faces: DataFrame
    chart: DataFrame
    warped: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    sec = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return ev.select(
        F.col("event_type").alias("field_id"),
        (F.col("user_id") % E_NLAT).cast("int").alias("i"),
        F.floor(sec * E_NPHI / 86400).cast("int").alias("j"),
        "value", "ts", "user_id", "event_id",
    )


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per (event type, ring, longitude bin), 0 where nothing happened."""
    cells = event_cells(spark, sf_dir).groupBy("field_id", "i", "j").agg(F.avg("value").alias("f"))
    grid = (
        cells.select("field_id").distinct()
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(E_NLAT - 1))))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(E_NPHI - 1))))
    )
    return grid.join(cells, ["field_id", "i", "j"], "left").select(
        "field_id", F.lit("v").alias("comp"), "i", "j", F.coalesce("f", F.lit(0.0)).alias("f")
    )


def build_lineitem_meshes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One lat-long mesh per supplier: discounts give the radius, taxes and discounts warp the chart."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_discount", "l_tax")
    hundredths = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    cells = li.groupBy(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("mesh_id"),
        (F.col("l_partkey") % L_NLAT).cast("int").alias("i"),
        (F.col("l_orderkey") % L_NPHI).cast("int").alias("j"),
    ).agg(
        (hundredths("l_discount") / F.count("*") / 100).alias("d"),
        (hundredths("l_tax") / F.count("*") / 100).alias("t"),
    )
    ids = cells.select("mesh_id").distinct()
    full = latlong_vertices(ids, F.lit(L_NLAT), F.lit(L_NPHI)).join(cells, ["mesh_id", "i", "j"], "left")
    r = 1 + 2 * F.coalesce("d", F.lit(0.0))
    grid = (F.col("i") >= 0) & (F.col("i") < L_NLAT)
    shift = lambda c, mid: F.when(grid, (F.coalesce(c, F.lit(mid)) - mid) / mid).otherwise(F.lit(0.0))
    theta_w = F.col("theta") + L_WARP * math.pi / (L_NLAT + 1) * shift("t", 0.04)
    phi_w = F.col("phi") + L_WARP * 2 * math.pi / L_NPHI * shift("d", 0.05)
    angles = full.select("mesh_id", "v", r.alias("r"), *[sin_cos(a).alias(n) for n, a in (
        ("th", F.col("theta")), ("ph", F.col("phi")), ("tw", theta_w), ("pw", phi_w))])
    on_sphere = lambda t, p: (F.col(t + ".sin") * F.col(p + ".cos"), F.col(t + ".sin") * F.col(p + ".sin"), F.col(t + ".cos"))
    wide = angles.select(
        "mesh_id", "v",
        *named(scale(on_sphere("th", "ph"), F.col("r")), ""),
        *named(on_sphere("th", "ph"), "s"),
        *named(on_sphere("tw", "pw"), "t"),
    )
    return wide, latlong_faces(ids, F.lit(L_NLAT), F.lit(L_NPHI))


def lineitem_meshes(spark: SparkSession, sf_dir: str) -> Meshes:
    """The supplier meshes as stored tables: derived from lineitem once per session and folder.

    Surface jobs start from vertex and face tables, as they would from a catalogue; the
    derivation itself is one scan, one aggregation and one join (build_lineitem_meshes).
    """
    built = []

    def part(k):
        def build():
            if not built:
                built.extend(build_lineitem_meshes(spark, sf_dir))
            return built[k]
        return build

    wide = dimension(spark, ("vertices", sf_dir), part(0))
    faces = dimension(spark, ("faces", sf_dir), part(1))
    return Meshes(
        vertices=wide.select("mesh_id", "v", "x", "y", "z"),
        faces=faces,
        chart=wide.select("mesh_id", "v", "sx", "sy", "sz"),
        warped=wide.select("mesh_id", "v", *[F.col("t" + k).alias("s" + k) for k in "xyz"]),
    )


def embedding_points(spark: SparkSession, sf_dir: str, one_cloud: bool = False) -> DataFrame:
    """First three dimensions of every embedding as a point of the cloud named by its label."""
    e = table(spark, sf_dir, "embeddings")
    cloud = F.lit("all") if one_cloud else F.col("label").cast("string")
    return e.select(
        cloud.alias("cloud_id"), F.col("vec_id").cast("bigint").alias("p"),
        *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")],
    )
