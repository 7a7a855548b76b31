"""Pieces of chart construction: innermost faces, balancing, displacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbtable.functions import geometry as g
from orbtable.functions.vec import dot, named, norm, sub, vec
from orbtable.session import settle


def mean_sq_displacement(now: DataFrame, before: DataFrame) -> DataFrame:
    """Mean squared move of the chart points of every mesh."""
    p = before.select("mesh_id", "v", *[F.col("s" + k).alias("o" + k) for k in "xyz"])
    d = sub(vec("s"), vec("o"))
    return now.join(p, ["mesh_id", "v"]).groupBy("mesh_id").agg(F.avg(dot(d, d)).alias("msd"))


def _two_least(s: DataFrame) -> DataFrame:
    """min and the runner-up by (s, f) come from one bounded aggregate each, not from ranking a whole mesh."""
    first = s.groupBy("mesh_id").agg(F.min(F.struct("s", "f")).alias("m"))
    rest = s.join(first, "mesh_id").where(F.col("f") != F.col("m.f")).groupBy("mesh_id").agg(F.min(F.struct("s", "f")).alias("m"))
    out = lambda df, k: df.select("mesh_id", "m.f", F.lit(k).alias("place"), "m.s")
    return out(first, 1).unionByName(out(rest, 2))


def innermost_faces(frame: DataFrame, pa, pb, pc, square=None) -> DataFrame:
    """The two faces nearest the plane's origin by summed corner distance, with their place 1 and 2.

    With `square` the faces as near as the second but for rounding are measured again by it, and that decides.
    """
    away = lambda p, by: F.sqrt(by(p[0]) + by(p[1]))
    total = lambda ends, by: away(ends[0], by) + away(ends[1], by) + away(ends[2], by)
    s = frame.select("mesh_id", "f", total((pa, pb, pc), lambda x: x * x).alias("s"), *[x.alias(k + c) for k, p in zip("abc", (pa, pb, pc)) for c, x in zip("uw", p)])
    two = _two_least(s)
    if square is None:
        return two
    reach = two.groupBy("mesh_id").agg((F.max("s") * (1 + 1e-12)).alias("reach"))
    near = settle(s.join(reach, "mesh_id").where(F.col("s") <= F.col("reach")), "nearest")
    ends = [(F.col(k + "u"), F.col(k + "w")) for k in "abc"]
    return _two_least(settle(near.select("mesh_id", "f", total(ends, square).alias("s")), "nearest"))


def puncture_balance(faces: DataFrame, plane: DataFrame, bigtri: DataFrame) -> DataFrame:
    """Centre a planar map, scale it so that the puncture and the innermost face balance, and lift it to the sphere.

    plane(mesh_id, v, u, w); bigtri(mesh_id, f) is the puncture. Returns a chart.
    """
    from orbtable.operators.mesh import face_corners

    mid = plane.groupBy("mesh_id").agg(F.avg("u").alias("mu"), F.avg("w").alias("mw"))
    cen = plane.join(mid, "mesh_id").select("mesh_id", "v", (F.col("u") - F.col("mu")).alias("u"), (F.col("w") - F.col("mw")).alias("w"))
    # the view from the other pole inverts the plane: (u, w) / |(u, w)|^2
    r2 = F.col("u") * F.col("u") + F.col("w") * F.col("w")
    inv = F.when(r2 > 0, r2)
    both = cen.select("*", F.coalesce(F.col("u") / inv, F.lit(float("inf"))).alias("iu"), F.coalesce(F.col("w") / inv, F.lit(float("inf"))).alias("iw"))
    fr = face_corners(faces, both, ["u", "w", "iu", "iw"])
    pt = lambda k, a, b: (F.col(k + a), F.col(k + b))
    inner = innermost_faces(fr, *[pt(k, "u", "w") for k in "abc"])
    cand = inner.join(bigtri.select("mesh_id", F.col("f").alias("big")), "mesh_id").where("f <> big")
    chosen = cand.groupBy("mesh_id").agg(F.min(F.struct("place", "f")).alias("m")).select("mesh_id", "m.f")
    dist = lambda p, q: F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))

    def side(a, b):
        p = [pt(k, a, b) for k in "abc"]
        return (dist(p[0], p[1]) + dist(p[1], p[2]) + dist(p[2], p[0])) / 3

    north = fr.join(bigtri.select("mesh_id", "f"), ["mesh_id", "f"]).select("mesh_id", side("u", "w").alias("north"))
    south = fr.join(chosen, ["mesh_id", "f"]).select("mesh_id", side("iu", "iw").alias("south"))
    k = north.join(south, "mesh_id").select("mesh_id", (F.sqrt(F.col("north") * F.col("south")) / F.col("north")).alias("k"))
    # the lift sends what is not finite to a pole, but here nothing belongs there: such a map is no map
    nan, size = F.lit(float("nan")), F.abs(F.col("u") * F.col("k")) + F.abs(F.col("w") * F.col("k"))
    lift = g.unstereo(F.col("u") * F.col("k"), F.col("w") * F.col("k"))
    return cen.join(k, "mesh_id", "left").select(
        "mesh_id", "v", *named(tuple(F.when(size < float("inf"), c).otherwise(nan) for c in lift), "s"))
