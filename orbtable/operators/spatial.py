"""Spatial joins by hashing into cells: nearest neighbours, point location, self-intersection.

Every broad phase is an equi-join on (group, level, cell). Levels halve the cell size, and
each point or triangle works at the level that suits its surroundings, so neither a dense
spot nor a few huge triangles blow up the candidate lists. No pair of tables is multiplied.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbtable.functions import geometry as g
from orbtable.functions.intersect import overlapping, with_plane
from orbtable.functions.vec import add, dot, fence, named, norm, scale, sub, unit_columns, vec
from orbtable.operators.mesh import adjacency, bbox, face_corners
from orbtable.operators.neighbours import knn_search
from orbtable.operators.rank import order_statistics
from orbtable.session import settle

MAX_LEVEL = 20
CELL = ["_cx", "_cy", "_cz"]  # apart from cx, cy, cz, the coordinates of corner c


def median_edge(frame: DataFrame) -> DataFrame:
    """Median edge length (index n div 2 over all corner edges) and the bin size max(2 median, extent / 8)."""
    a, b, c = vec("a"), vec("b"), vec("c")
    e = frame.select("mesh_id", F.explode(F.array(*g.edge_lengths(a, b, c))).alias("e"))
    ext = F.greatest(*[F.greatest(p, q, r) - F.least(p, q, r) for p, q, r in zip(a, b, c)])
    big = frame.groupBy("mesh_id").agg(F.max(ext).alias("ext"))
    return order_statistics(e, ["mesh_id"], "e", {"med": ("half", 0.5)}).join(big, "mesh_id").select(
        "mesh_id", "med", F.greatest(2 * F.col("med"), F.col("ext") / 8).alias("h"))


# ------------------------------------------------------------------ nearest neighbours


def _cells(level: Column) -> list[Column]:
    """Cell of x, y, z in the cube (ox, oy, oz, span) at a level; outside points go to the nearest cell."""
    n = F.shiftleft(F.lit(1).cast("bigint"), MAX_LEVEL) / F.pow(F.lit(2.0), F.lit(MAX_LEVEL) - level)
    out = []
    for k in "xyz":
        c = F.floor((F.col(k) - F.col("o" + k)) / F.col("span") * n)
        out.append(F.least(F.greatest(c, F.lit(0)), n.cast("bigint") - 1).cast("bigint").alias("_c" + k))
    return out


def knn_join(points: DataFrame, k: int) -> DataFrame:
    """knn(cloud_id, p, rank, q, d2): the k nearest of every point, itself included."""
    pts = points.select(F.col("cloud_id").alias("grp"), F.col("p").alias("id"), "x", "y", "z")
    out = knn_search(pts, None, k)
    return out.select(F.col("grp").alias("cloud_id"), F.col("qid").alias("p"), "rank", F.col("id").alias("q"), "d2")


def knn_diff_rows(one: DataFrame, two: DataFrame) -> DataFrame:
    """Points whose neighbour sets differ between two kNN tables."""
    pack = lambda df, name: df.groupBy("cloud_id", "p").agg(F.array_sort(F.collect_set("q")).alias(name))
    j = pack(one, "s1").join(pack(two, "s2"), ["cloud_id", "p"], "full_outer")
    return j.where(~F.col("s1").eqNullSafe(F.col("s2"))).select("cloud_id", "p")


def nearest_vertex(chart: DataFrame, queries: DataFrame) -> DataFrame:
    """The chart vertex with the largest dot product for each query direction(mesh_id, q, x, y, z).

    On unit vectors that is the nearest point, so it is a 1-nearest search.
    """
    pts = chart.select(F.col("mesh_id").alias("grp"), F.col("v").alias("id"), *[c.alias(k) for c, k in zip(vec("s"), "xyz")])
    asks = queries.select(F.col("mesh_id").alias("grp"), F.col("q").alias("qid"), *unit_columns(vec(""), ""))
    return knn_search(pts, asks, 1).select(
        F.col("grp").alias("mesh_id"), F.col("qid").alias("q"), F.col("id").alias("v"), (1 - F.col("d2") / 2).alias("dot"))


# ------------------------------------------------------------------ point location


def _covered(lo: list[Column], hi: list[Column], size: Column) -> list[Column]:
    """Three integer sequences of the cells a box covers."""
    return [F.sequence(F.floor(a / size).cast("bigint"), F.floor(b / size).cast("bigint")) for a, b in zip(lo, hi)]


def _level_size(level: Column) -> Column:
    """Cell size at a level of the hierarchy over all space: 2^-level."""
    return F.pow(F.lit(2.0), -level.cast("double"))


def _level_for(width: Column) -> Column:
    """Finest level whose cells are at least `width` wide; any level is correct, this one covers 8 cells at most."""
    w = F.when(width > 2.0**-40, width).otherwise(F.lit(2.0**-40))
    return F.floor(-F.log2(w)).cast("int")


# fixed values: barycentric slack and the smallest usable determinant
INSIDE_TOL = -1e-12
DET_MIN = 1e-14


def containing_faces(faces: DataFrame, chart: DataFrame, queries: DataFrame) -> DataFrame:
    """Every (query, face) with the query direction inside the spherical triangle, with weights summing to 1.

    A triangle lies in the cap around its mean direction that reaches its farthest corner. It
    is hashed once at the level of that cap's size; a query probes one cell per level in use.
    """
    unit = chart.select("mesh_id", "v", *unit_columns(vec("s"), "s"))
    fr = face_corners(faces, unit, ["sx", "sy", "sz"])
    A, B, C = vec("as"), vec("bs"), vec("cs")
    mean = add(A, B, C)
    n = norm(mean)
    far = F.least(*[dot(mean, p) for p in (A, B, C)]) / F.when(n > 1e-9, n)
    radius = F.coalesce(F.when(far > 0, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * far)) + 1e-9), F.lit(2.5))
    mid = scale(mean, 1 / F.when(n > 1e-9, n).otherwise(F.lit(1.0)))
    corner_cols = [k + "s" + c for k in "abc" for c in "xyz"]
    boxed = fr.select("mesh_id", "f", "a", "b", "c", *corner_cols, radius.alias("rad"), *named(mid, "m"))
    boxed = boxed.withColumn("reach2", F.col("rad") * F.col("rad"))
    boxed = boxed.withColumn("level", _level_for(2 * F.col("rad")))
    size = _level_size(F.col("level"))
    seqs = _covered([F.col("m" + k) - F.col("rad") for k in "xyz"], [F.col("m" + k) + F.col("rad") for k in "xyz"], size)
    binned = boxed
    for c, s in zip(CELL, seqs):
        binned = binned.withColumn(c, F.explode(s))
    binned = binned.drop("rad")
    used = boxed.groupBy("mesh_id").agg(F.collect_set("level").alias("levels"))  # a few dozen numbers at most
    probe = queries.select("mesh_id", "q", *unit_columns(vec(""), "p")).join(used, "mesh_id").select(
        "mesh_id", "q", "px", "py", "pz", F.explode("levels").alias("level"))
    size = _level_size(F.col("level"))
    probe = probe.select("*", *[F.floor(F.col("p" + k) / size).cast("bigint").alias("_c" + k) for k in "xyz"])
    off = sub(vec("m"), vec("p"))
    # the cap test is a cheap join condition; the determinants run on what is left
    cand = probe.join(binned, ["mesh_id", "level", *CELL]).where(dot(off, off) <= F.col("reach2"))
    det, w0, w1, w2 = g.barycentric(A, B, C, vec("p"))
    tested = fence(cand, ["mesh_id", "q", "f", "a", "b", "c"], w0.alias("w0"), w1.alias("w1"), w2.alias("w2"))
    hit = tested.where((F.col("w0") >= INSIDE_TOL) & (F.col("w1") >= INSIDE_TOL) & (F.col("w2") >= INSIDE_TOL))
    s = F.col("w0") + F.col("w1") + F.col("w2")
    return hit.select("mesh_id", "q", "f", "a", "b", "c", (F.col("w0") / s).alias("w0"), (F.col("w1") / s).alias("w1"), (F.col("w2") / s).alias("w2"))


def locate(faces: DataFrame, chart: DataFrame, queries: DataFrame, label: bool = True) -> DataFrame:
    """located(mesh_id, q, f, a, b, c, w0, w1, w2, how): one face per query.

    Preference: a face of the nearest vertex ('vertex'), a face of one of its neighbours
    ('ring'), any face ('sweep'), else the nearest vertex itself with weight 1 ('nearest').
    All containing faces come from one hashed join; the preference only ranks them, so the
    nearest vertex is needed where a query has none or several. With label=False it is
    searched for those alone, and `how` is 'only' elsewhere; faces and weights are the same.
    """
    hits = settle(containing_faces(faces, chart, queries), "hits")
    count = hits.groupBy("mesh_id", "q").agg(F.count("*").alias("n"))
    if label:
        asked, only = queries, None
    else:
        single = settle(count.where("n = 1").select("mesh_id", "q"), "single")
        asked = queries.join(single, ["mesh_id", "q"], "leftanti")
        only = hits.join(single, ["mesh_id", "q"], "leftsemi").withColumn("how", F.lit("only"))
    near = settle(nearest_vertex(chart, asked), "nearest").select("mesh_id", "q", F.col("v").alias("v0"))
    open_hits = hits.join(near, ["mesh_id", "q"])
    open_hits = settle(open_hits.withColumn("own", F.array_contains(F.array("a", "b", "c"), F.col("v0"))), "open")
    ring = open_hits.where("NOT own").select("mesh_id", "q", "f", "v0", F.explode(F.array("a", "b", "c")).alias("u")).join(
        adjacency(faces).withColumnRenamed("v", "v0"), ["mesh_id", "v0", "u"], "leftsemi").select("mesh_id", "q", "f").distinct()
    tier = F.when(F.col("own"), 0).when(F.col("in_ring"), 1).otherwise(2)
    ranked = open_hits.join(ring.withColumn("in_ring", F.lit(True)), ["mesh_id", "q", "f"], "left")
    pick = ranked.groupBy("mesh_id", "q").agg(
        F.min(F.struct(tier.alias("tier"), "f", "a", "b", "c", "w0", "w1", "w2")).alias("m"))
    how = F.element_at(F.array(F.lit("vertex"), F.lit("ring"), F.lit("sweep")), F.col("m.tier") + 1)
    found = pick.select("mesh_id", "q", "m.f", "m.a", "m.b", "m.c", "m.w0", "m.w1", "m.w2", how.alias("how"))
    lost = near.join(found.select("mesh_id", "q"), ["mesh_id", "q"], "leftanti")
    first = faces.select("mesh_id", "f", "a", "b", "c", F.explode(F.array("a", "b", "c")).alias("v0")).join(
        lost.select("mesh_id", "v0").distinct(), ["mesh_id", "v0"], "leftsemi").groupBy("mesh_id", "v0").agg(
        F.min(F.struct("f", "a", "b", "c")).alias("m"))
    one = lambda c: F.when(F.col("m." + c) == F.col("v0"), F.lit(1.0)).otherwise(F.lit(0.0))
    rest = lost.join(first, ["mesh_id", "v0"]).select(
        "mesh_id", "q", "m.f", "m.a", "m.b", "m.c", one("a").alias("w0"), one("b").alias("w1"), one("c").alias("w2"), F.lit("nearest").alias("how"))
    out = found.unionByName(rest)
    return out if only is None else out.unionByName(only)


def pl_interpolate(located: DataFrame, field: DataFrame, cols: list[str]) -> DataFrame:
    """Barycentric mean of vertex columns at every located query."""
    corner = lambda k, w: F.struct(F.col(k).alias("v"), F.col(w).alias("w"))
    rows = located.select("mesh_id", "q", F.inline(F.array(corner("a", "w0"), corner("b", "w1"), corner("c", "w2"))))
    return rows.join(field.select("mesh_id", "v", *cols), ["mesh_id", "v"]).groupBy("mesh_id", "q").agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])


# ------------------------------------------------------------------ self-intersection


def _boxes(vertices: DataFrame, faces: DataFrame, rel_tol: float) -> DataFrame:
    """Distinct triangles with multiplicity, plane, tolerance and bounding box."""
    tri = faces.groupBy("mesh_id", "a", "b", "c").agg(F.min("f").alias("f"), F.count("*").alias("m"))
    fr = face_corners(tri, vertices, ["x", "y", "z"], ["m"])
    corner = [k + c for k in "abc" for c in "xyz"]
    keep = ["mesh_id", "f", "m", "a", "b", "c", *corner]
    fr = with_plane(fr, keep)
    # the tolerance scales with the box of the faces, as isolated vertices do not take part
    ext = fr.groupBy("mesh_id").agg(
        *[F.min(F.least("a" + k, "b" + k, "c" + k)).alias("gl" + k) for k in "xyz"],
        *[F.max(F.greatest("a" + k, "b" + k, "c" + k)).alias("gh" + k) for k in "xyz"])
    ext = ext.select("mesh_id", (rel_tol * norm(sub(vec("gh"), vec("gl")))).alias("tol"))
    return fr.join(ext, "mesh_id").select(
        *keep, "nx", "ny", "nz", "nd", "tol",
        *[F.least("a" + k, "b" + k, "c" + k).alias("l" + k) for k in "xyz"],
        *[F.greatest("a" + k, "b" + k, "c" + k).alias("h" + k) for k in "xyz"])


def box_pairs(boxed: DataFrame) -> DataFrame:
    """Each unordered pair of triangles of a mesh whose boxes overlap within tol, exactly once.

    Returns (mesh_id, pf, pa, pb, pc, qf, qa, qb, qc); only boxes and vertex ids travel.

    A triangle is stored in the few cells it covers at the level of its own size, and probes
    the cells it covers at every coarser level in use. A pair meets at the coarser of its two
    levels and is kept only in the first cell both cover, so nothing has to be deduplicated.
    """
    extent = F.greatest(*[F.col("h" + k) - F.col("l" + k) for k in "xyz"]) + 2 * F.col("tol")
    own = boxed.withColumn("own", _level_for(extent))

    def cells(df: DataFrame, level: str) -> DataFrame:
        size = _level_size(F.col(level))
        for k in "xyz":
            df = df.withColumn("i" + k, F.floor((F.col("l" + k) - F.col("tol")) / size).cast("bigint")).withColumn(
                "j" + k, F.floor((F.col("h" + k) + F.col("tol")) / size).cast("bigint"))
        for k in "xyz":
            df = df.withColumn("_c" + k, F.explode(F.sequence("i" + k, "j" + k)))
        return df.drop("jx", "jy", "jz")

    levels = own.groupBy("mesh_id").agg(F.collect_set("own").alias("levels"))
    slim = ["f", "a", "b", "c", *["l" + k for k in "xyz"], *["h" + k for k in "xyz"]]
    own = own.select("mesh_id", "tol", "own", *slim)
    stored = cells(own.withColumnRenamed("own", "level"), "level")
    stored = stored.select("mesh_id", "level", *CELL, *[F.col(c).alias("q" + c) for c in slim], *[F.col("i" + k).alias("qi" + k) for k in "xyz"])
    probing = own.join(levels, "mesh_id").withColumn("level", F.explode(F.filter("levels", lambda t: t <= F.col("own"))))
    probing = cells(probing.drop("levels"), "level")
    probing = probing.select("mesh_id", "level", *CELL, "own", "tol", *[F.col(c).alias("p" + c) for c in slim], *[F.col("i" + k).alias("pi" + k) for k in "xyz"])
    met = probing.join(stored, ["mesh_id", "level", *CELL])
    once = (F.col("own") > F.col("level")) | (F.col("pf") < F.col("qf"))
    canonical = F.lit(True)
    boxes = F.lit(True)
    for k in "xyz":
        canonical = canonical & (F.greatest("pi" + k, "qi" + k) == F.col("_c" + k))
        boxes = boxes & (F.col("pl" + k) <= F.col("qh" + k) + F.col("tol")) & (F.col("ql" + k) <= F.col("ph" + k) + F.col("tol"))
    return met.where(once & canonical & boxes).select("mesh_id", *[s + c for s in "pq" for c in ("f", "a", "b", "c")])


def not_adjacent() -> Column:
    """The two triangles of a pair share no vertex."""
    return ~F.arrays_overlap(F.array("pa", "pb", "pc"), F.array("qa", "qb", "qc"))


#: Triangles of a mesh whose pairs one task forms: at most 131,000 pairs, 30 MB.
PAIRED = 512
_BODY = ["m", *[k + c for k in "abc" for c in "xyz"], "nx", "ny", "nz", "nd"]


def close_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one small mesh that `box_pairs` finds and that do not share a vertex, with both bodies.

    A pair with one triangle clearly beyond the plane of the other, by much more than rounding, is left out: it cannot cross.
    """
    t = rows.sort_values("f", ignore_index=True)
    corners = t[_BODY[1:10]].to_numpy(float).reshape(-1, 3, 3)
    low, high, tol = corners.min(1), corners.max(1), t["tol"].to_numpy(float)[:, None]
    ids, normal, offset = t[["a", "b", "c"]].to_numpy(), t[["nx", "ny", "nz"]].to_numpy(float), t["nd"].to_numpy(float)
    meet = np.triu(np.ones((len(t), len(t)), bool), 1)
    for k in range(3):
        meet &= (low[:, None, k] <= high[None, :, k] + tol) & (low[None, :, k] <= high[:, None, k] + tol)
    p, q = np.nonzero(meet)
    apart = ~(ids[p][:, :, None] == ids[q][:, None, :]).any((1, 2))
    p, q = p[apart], q[apart]
    slack = 1e-9 * np.abs(corners).max(initial=0.0) + t["tol"].to_numpy(float)[p]

    def beyond(one, other):
        d = np.einsum("nkc,nc->nk", corners[one], normal[other]) + offset[other][:, None]
        return (d.min(1) > slack) | (d.max(1) < -slack)

    near = ~(beyond(p, q) | beyond(q, p))
    side = lambda at, pre: t.loc[at[near], _BODY].reset_index(drop=True).add_prefix(pre)
    both = pd.concat([side(p, "p"), side(q, "q")], axis=1)
    return both.assign(mesh_id=t["mesh_id"].iloc[0], tol=t["tol"].iloc[0])


def self_intersections(vertices: DataFrame, faces: DataFrame, rel_tol: float = 1e-10, small: int = PAIRED) -> DataFrame:
    """Number of intersecting triangle pairs without a common vertex, per mesh (0 = embedded).

    Repeated faces count with their multiplicity; copies of a face share its vertices and so
    never pair with each other. The pairs of a mesh of at most `small` faces are formed inside a task and do not move.
    """
    large = settle(faces.groupBy("mesh_id").agg(F.count("*").alias("n")).where(F.col("n") > small).select("mesh_id"), "large")
    some = large.limit(1).count() > 0
    own = lambda how: [df.join(large, "mesh_id", how) if some else df for df in (vertices, faces)]
    flat = "nx IS NOT NULL"
    schema = "mesh_id string, tol double, " + ", ".join(f"{s}{c} {'bigint' if c == 'm' else 'double'}" for s in "pq" for c in _BODY)
    pairs = _boxes(*own("left_anti"), rel_tol).where(flat).select("mesh_id", "f", "a", "b", "c", "tol", *_BODY).groupBy("mesh_id").applyInPandas(
        lambda df: close_pairs(df)[["mesh_id", "tol", *[s + c for s in "pq" for c in _BODY]]], schema)
    if some:
        boxed = settle(_boxes(*own("left_semi"), rel_tol).where(flat), "boxes")
        side = lambda p, *more: boxed.select("mesh_id", F.col("f").alias(p + "f"), *[F.col(c).alias(p + c) for c in _BODY], *more)
        met = box_pairs(boxed).where(not_adjacent()).select("mesh_id", "pf", "qf")
        pairs = pairs.unionByName(met.join(side("p", "tol"), ["mesh_id", "pf"]).join(side("q"), ["mesh_id", "qf"]).drop("pf", "qf"))
    tested = overlapping(pairs, ["mesh_id", "pm", "qm"])
    n = tested.groupBy("mesh_id").agg(F.sum(F.when(F.col("hit"), F.col("pm") * F.col("qm")).otherwise(0)).alias("pairs"))
    return faces.select("mesh_id").distinct().join(n, "mesh_id", "left").select(
        "mesh_id", F.coalesce("pairs", F.lit(0).cast("bigint")).alias("pairs"))


# ------------------------------------------------------------------ grid interpolation


def ring_brackets(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """For every coarse ring (grid, r, theta) the fine rows (grid, i, theta) on both sides and the weight of the second.

    An as-of match by one ordered pass over both ring lists of a grid; the ends are clamped.
    """
    order = Window.partitionBy("grid").orderBy("theta")
    whole = Window.partitionBy("grid")
    f = fine.select("grid", "i", "theta", F.lead("theta").over(order).alias("up"), F.lead("i").over(order).alias("ib"),
                    F.lag("theta").over(order).alias("down"), F.lag("i").over(order).alias("ia"))
    seg = f.where("up IS NOT NULL").select("grid", F.col("theta"), F.struct(F.col("i").alias("a"), F.col("ib").alias("b"), F.col("theta").alias("ta"), F.col("up").alias("tb")).alias("seg"), F.lit(None).cast("int").alias("r"))
    both = seg.unionByName(coarse.select("grid", "theta", F.lit(None).cast(seg.schema["seg"].dataType).alias("seg"), "r"))
    run = Window.partitionBy("grid").orderBy("theta", F.col("r").asc_nulls_first())
    asof = both.withColumn("hit", F.coalesce(
        F.last("seg", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)),
        F.first("seg", ignorenulls=True).over(run.rowsBetween(0, Window.unboundedFollowing))))
    w = (F.col("theta") - F.col("hit.ta")) / (F.col("hit.tb") - F.col("hit.ta"))
    return asof.where("r IS NOT NULL").select(
        "grid", "r", "hit.a", "hit.b", F.least(F.lit(1.0), F.greatest(F.lit(0.0), w)).alias("w"))


def meridian_brackets(meridians: DataFrame, nphi_fine: Column) -> DataFrame:
    """For every meridian (grid, m, nphi) the fine columns on both sides and the weight of the second."""
    pos = F.col("m") * nphi_fine / F.col("nphi")
    c0 = F.floor(pos).cast("int") % nphi_fine
    return meridians.select("grid", "m", c0.alias("c0"), ((c0 + 1) % nphi_fine).alias("c1"), (pos - F.floor(pos)).alias("w"))
