"""Loop subdivision, limit points, and the surface seen through its chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbtable.functions.geometry import limit_omega, loop_beta
from orbtable.functions.vec import unit_columns, vec
from orbtable.operators.mesh import adjacency, numbered_edges
from orbtable.operators.spatial import locate, pl_interpolate
from orbtable.session import settle
from orbtable.sources.generate import split_faces

QUARTERS = [("a", "ab", "ca"), ("ab", "b", "bc"), ("ca", "bc", "c"), ("ab", "bc", "ca")]


def _neighbour_sums(faces: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    nb = table.select("mesh_id", F.col("v").alias("u"), *[F.col(c).alias("_" + c) for c in cols])
    return adjacency(faces).join(nb, ["mesh_id", "u"]).groupBy("mesh_id", "v").agg(
        F.count("*").alias("n"), *[F.sum("_" + c).alias("_" + c) for c in cols])


def loop_subdivide_field(faces: DataFrame, table: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """One Loop round for any vertex columns: (refined table, refined faces).

    Old vertices keep their ids; the vertex of an edge is numbered by the edge's first sight.
    """
    e = numbered_edges(faces, table)
    n, beta = F.col("n"), loop_beta(F.col("n"))
    even = table.select("mesh_id", "v", *cols).join(_neighbour_sums(faces, table, cols), ["mesh_id", "v"], "left").select(
        "mesh_id", "v",
        *[F.when(n.isNull(), F.col(c)).otherwise((1 - n * beta) * F.col(c) + beta * F.col("_" + c)).alias(c) for c in cols])
    side = lambda key, pre: table.select("mesh_id", F.col("v").alias(key), *[F.col(c).alias(pre + c) for c in cols])
    wide = e.join(side("lo", "p"), ["mesh_id", "lo"]).join(side("hi", "q"), ["mesh_id", "hi"])
    wide = wide.join(side("opp1", "r"), ["mesh_id", "opp1"]).join(side("opp2", "s"), ["mesh_id", "opp2"])
    ends = lambda c: F.col("p" + c) + F.col("q" + c)
    odd = wide.select("mesh_id", F.col("id").alias("v"), *[
        F.when(F.col("n") == 2, 0.375 * ends(c) + 0.125 * (F.col("r" + c) + F.col("s" + c))).otherwise(0.5 * ends(c)).alias(c)
        for c in cols])
    return even.unionByName(odd), split_faces(faces, e, QUARTERS)


def loop_subdivide(vertices: DataFrame, faces: DataFrame, chart: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One Loop round of a charted mesh; the chart follows the same rules and returns to the sphere."""
    both = vertices.join(chart, ["mesh_id", "v"])
    fine, ff = loop_subdivide_field(faces, both, ["x", "y", "z", "sx", "sy", "sz"])
    return (fine.select("mesh_id", "v", "x", "y", "z"), ff,
            fine.select("mesh_id", "v", *unit_columns(vec("s"), "s")))


def limit_vertex(vertices: DataFrame, faces: DataFrame, cols: list[str]) -> DataFrame:
    """Limit position of every vertex under endless subdivision."""
    n, w = F.col("n"), limit_omega(F.col("n"))
    return vertices.select("mesh_id", "v", *cols).join(_neighbour_sums(faces, vertices, cols), ["mesh_id", "v"]).select(
        "mesh_id", "v", *[((1 - n * w) * F.col(c) + w * F.col("_" + c)).alias(c) for c in cols])


def limit_sampling(vertices: DataFrame, faces: DataFrame, chart: DataFrame, queries: DataFrame, rounds: int = 1) -> DataFrame:
    """The smooth surface at directions: refine, push vertices to the limit, locate, interpolate.

    Both the surface and its chart go to the limit, so the error falls by four per round.
    """
    cols = ["x", "y", "z", "sx", "sy", "sz"]
    both, f = vertices.join(chart, ["mesh_id", "v"]), faces
    for _ in range(rounds):
        both, f = loop_subdivide_field(f, both, cols)
        both, f = settle(both, "loop"), settle(f, "loop")
    lim = settle(limit_vertex(both, f, cols), "limit")
    smooth_chart = lim.select("mesh_id", "v", *unit_columns(vec("s"), "s"))
    return pl_interpolate(locate(f, smooth_chart, queries, label=False), lim, ["x", "y", "z"])


def resample(vertices: DataFrame, faces: DataFrame, chart: DataFrame, queries: DataFrame) -> DataFrame:
    """Piecewise-linear surface points at query directions(mesh_id, q, x, y, z)."""
    return pl_interpolate(locate(faces, chart, queries, label=False), vertices, ["x", "y", "z"])
