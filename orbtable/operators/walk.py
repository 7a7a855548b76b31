"""Point location that starts from a known face: each point walks over the chart toward its place.

A face travels with the (at most three) faces across its edges, so one join decides whether a point lies
in any of the four, and else across which edge it goes on: the one it lies farthest beyond. Only points still
under way are joined again. Walks of more than a number of steps, walks without a start or an edge to
cross, and points of charts on which a containing face is not unique are located in full, so the
result is that of `locate`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from orbtable.functions import geometry as g
from orbtable.functions.vec import dot, unit_columns, vec
from orbtable.operators.mesh import edges, face_corners, half_edges
from orbtable.operators.spatial import INSIDE_TOL, locate
from orbtable.session import settle

CORNERS = [k + "s" + c for k in "abc" for c in "xyz"]


def _unit_corners(faces: DataFrame, chart: DataFrame) -> DataFrame:
    unit = chart.select("mesh_id", "v", *unit_columns(vec("s"), "s"))
    return face_corners(faces, unit, ["sx", "sy", "sz"])


def single_sheet(frame: DataFrame) -> DataFrame:
    """Ids of meshes whose chart covers the sphere exactly once: no fold, and solid angles that sum to 4 pi.

    Faces turned all one way make every point covered equally often, and the sum says how often. Any
    undefined angle counts as a fold.
    """
    A, B, C = vec("as"), vec("bs"), vec("cs")
    det = g.signed_volume(A, B, C)
    angle = 2 * F.atan2(det, 1 + dot(A, B) + dot(B, C) + dot(C, A))
    m = frame.select("mesh_id", det.alias("det"), angle.alias("angle")).groupBy("mesh_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("det") > 0).alias("pos"), F.count_if(F.col("det") < 0).alias("neg"), F.sum("angle").alias("turn"))
    one_way = (F.col("pos") == F.col("n")) | (F.col("neg") == F.col("n"))
    return m.where(one_way & (F.abs(F.abs("turn") - 4 * math.pi) < 1e-6)).select("mesh_id")


def face_patches(faces: DataFrame, chart: DataFrame) -> DataFrame:
    """(mesh_id, f, near): every face of a singly covering chart with itself and the faces across its edges.

    `near` holds at most four structs of face, vertices, unit corner directions and `side`, the corner of f
    that the shared edge lies opposite to (3 for f itself). An edge of more than two faces leads nowhere.
    Written once, to be met by every step of a walk.
    """
    frame = settle(_unit_corners(faces, chart), "corners")
    frame = frame.join(settle(single_sheet(frame), "sheet"), "mesh_id", "leftsemi")
    two = edges(faces).where("n = 2 AND f1 <> f2").select("mesh_id", "lo", "hi", "f1", "f2")
    half = half_edges(faces).select("mesh_id", "f", F.least("u", "w").alias("lo"), F.greatest("u", "w").alias("hi"), ((F.col("k") + 2) % 3).alias("side"))
    pairs = half.join(two, ["mesh_id", "lo", "hi"]).select("mesh_id", "f", (F.col("f1") + F.col("f2") - F.col("f")).alias("t"), "side")
    pairs = pairs.unionByName(frame.select("mesh_id", "f", F.col("f").alias("t"), F.lit(3).alias("side")))
    far = frame.withColumnRenamed("f", "t")
    rows = pairs.join(far, ["mesh_id", "t"]).select("mesh_id", "f", F.struct("t", "side", "a", "b", "c", *CORNERS).alias("face"))
    return settle(rows.groupBy("mesh_id", "f").agg(F.collect_list("face").alias("near")), "patches")


def visit(patches: DataFrame, queries: DataFrame) -> DataFrame:
    """One step of queries(mesh_id, q, px, py, pz, f): adds `pick`, the containing face of f's patch or else the one to go to.

    pick is NULL where the patch is missing; pick.inside tells whether the face holds the point, and
    pick.beyond how far it lies beyond the edge to be crossed (not positive: there is no such edge).
    """
    P = vec("p")

    def weigh(t):
        A, B, C = ([t[k + "s" + c] for c in "xyz"] for k in "abc")
        _, w0, w1, w2 = g.barycentric(A, B, C, P)
        return F.struct(t["t"].alias("f"), t["side"].alias("side"), *[t[k].alias(k) for k in "abc"], w0.alias("w0"), w1.alias("w1"), w2.alias("w2"))

    def judged(t):
        inside = F.coalesce((t["w0"] >= INSIDE_TOL) & (t["w1"] >= INSIDE_TOL) & (t["w2"] >= INSIDE_TOL), F.lit(False))
        own = F.col("own")
        beyond = -F.when(t["side"] == 0, own["w0"]).when(t["side"] == 1, own["w1"]).when(t["side"] == 2, own["w2"])
        return F.struct(inside.alias("inside"), beyond.alias("beyond"), *[t[c].alias(c) for c in ("f", "a", "b", "c", "w0", "w1", "w2")])

    met = queries.join(patches, ["mesh_id", "f"], "left").withColumn("met", F.transform("near", weigh))
    met = met.withColumn("own", F.filter("met", lambda t: t["side"] == 3)[0])
    return met.select("mesh_id", "q", "px", "py", "pz", "f", F.array_max(F.transform("met", judged)).alias("pick"))


def locate_from(faces: DataFrame, chart: DataFrame, patches: DataFrame, queries: DataFrame, steps: int = 8) -> DataFrame:
    """located(mesh_id, q, f, a, b, c, w0, w1, w2) of queries(mesh_id, q, x, y, z, f), f being where to start.

    After `steps` steps, or where a walk is stuck, has no start or its chart is not single, `locate` decides.
    """
    at = ["mesh_id", "q", "f", "a", "b", "c", "w0", "w1", "w2"]
    open_ = queries.select("mesh_id", "q", *unit_columns(vec(""), "p"), "f")
    found, lost = [], []
    point = ["mesh_id", "q", "px", "py", "pz"]
    done = F.coalesce("pick.inside", F.lit(False))
    way = F.when(done, "done").when(F.col("pick.beyond") > 0, "on").otherwise("stuck")
    for _ in range(steps):
        seen = Observation()
        step = settle(visit(patches, open_).withColumn("way", way).observe(
            seen, F.count_if(F.col("way") == "on").alias("on"), F.count_if(F.col("way") == "stuck").alias("stuck")), "walk")
        s = F.col("pick.w0") + F.col("pick.w1") + F.col("pick.w2")
        found.append(step.where("way = 'done'").select("mesh_id", "q", *["pick." + c for c in "fabc"], *[(F.col(f"pick.w{i}") / s).alias(f"w{i}") for i in range(3)]))
        if seen.get["stuck"]:
            lost.append(step.where("way = 'stuck'").select(*point))
        open_ = step.where("way = 'on'").select(*point, "pick.f")
        if not seen.get["on"]:
            break
    else:
        lost.append(open_.select(*point))
    out = found[0] if found else None
    for df in found[1:]:
        out = out.unionByName(df)
    if lost:
        rest = lost[0]
        for df in lost[1:]:
            rest = rest.unionByName(df)
        full = locate(faces, chart, rest.select("mesh_id", "q", *[F.col("p" + c).alias(c) for c in "xyz"]), label=False).select(*at)
        out = full if out is None else out.unionByName(full)
    return out
