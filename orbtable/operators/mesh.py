"""Connectivity and per-mesh geometry: every table is keyed by mesh_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbtable.functions.vec import cross, dot, named, norm, scale, sub, vec
from orbtable.operators.rank import number_by_ordinal


def face_corners(faces: DataFrame, vertices: DataFrame, cols: list[str], extra: list[str] = ()) -> DataFrame:
    """Every face with the chosen vertex columns of its three corners, prefixed a, b and c.

    Three equi-joins on (mesh_id, vertex). The vertex side is one shuffle, reused three
    times, or a broadcast where its measured size allows.
    """
    out = faces.select("mesh_id", "f", "a", "b", "c", *extra)
    for k in "abc":
        side = vertices.select("mesh_id", F.col("v").alias(k), *[F.col(c).alias(k + c) for c in cols])
        out = out.join(side, ["mesh_id", k])
    return out


def charted_corners(faces: DataFrame, vertices: DataFrame, chart: DataFrame) -> DataFrame:
    """face_corners with positions (ax..cz) and chart directions (asx..csz)."""
    both = vertices.select("mesh_id", "v", "x", "y", "z").join(chart, ["mesh_id", "v"])
    return face_corners(faces, both, ["x", "y", "z", "sx", "sy", "sz"])


def half_edges(faces: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Three rows per face: directed edge (u, w), opposite vertex, and ordinal 3 f + k."""
    trip = lambda k, u, w, o: F.struct(F.lit(k).alias("k"), F.col(u).alias("u"), F.col(w).alias("w"), F.col(o).alias("opp"))
    rows = F.array(trip(0, "a", "b", "c"), trip(1, "b", "c", "a"), trip(2, "c", "a", "b"))
    return faces.select("mesh_id", "f", *extra, F.inline(rows)).withColumn("ord", 3 * F.col("f") + F.col("k"))


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges (lo, hi) with face count, the opposite vertices and the first half-edge.

    opp1 <= opp2 are the extreme opposite vertices: the two of them on a manifold edge.
    """
    return half_edges(faces).groupBy(
        "mesh_id", F.least("u", "w").alias("lo"), F.greatest("u", "w").alias("hi")
    ).agg(
        F.count("*").alias("n"), F.min("opp").alias("opp1"), F.max("opp").alias("opp2"), F.min("ord").alias("ord"),
        F.min("f").alias("f1"), F.max("f").alias("f2"),
    )


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Edges seen an odd number of times, as a parity toggle leaves them."""
    return edges(faces).where(F.col("n") % 2 == 1).select("mesh_id", "lo", "hi")


def face_pairs(faces: DataFrame) -> DataFrame:
    """The two faces across every shared edge: the first face of the edge with each later one."""
    e = edges(faces)
    two = e.where("n = 2").select("mesh_id", "lo", "hi", "f1", "f2")
    many = e.where("n > 2").select("mesh_id", "lo", "hi", F.col("ord").alias("first"))
    h = half_edges(faces).select(
        "mesh_id", F.least("u", "w").alias("lo"), F.greatest("u", "w").alias("hi"), F.col("f").alias("f2"), "ord")
    rest = h.join(many, ["mesh_id", "lo", "hi"]).where("ord <> first").select(
        "mesh_id", "lo", "hi", F.floor(F.col("first") / 3).cast("bigint").alias("f1"), "f2")
    return two.unionByName(rest)


def adjacency(faces: DataFrame) -> DataFrame:
    """Symmetric neighbours (v, u) without self loops."""
    e = edges(faces).where("lo <> hi")
    both = F.array(F.struct(F.col("lo").alias("v"), F.col("hi").alias("u")), F.struct(F.col("hi").alias("v"), F.col("lo").alias("u")))
    return e.select("mesh_id", F.inline(both))


def undirected(pairs: DataFrame, v: str, u: str) -> DataFrame:
    """Every pair (v, u) of a mesh in both directions, once; a pair of equal ends is one row."""
    row = lambda a, b: F.struct(F.col(a).alias("v"), F.col(b).alias("u"))
    both = F.when(F.col("lo") == F.col("hi"), F.array(row("lo", "hi"))).otherwise(F.array(row("lo", "hi"), row("hi", "lo")))
    return pairs.select("mesh_id", F.least(v, u).alias("lo"), F.greatest(v, u).alias("hi")).distinct().select("mesh_id", F.inline(both))


def vertex_faces(faces: DataFrame) -> DataFrame:
    """One row per (vertex, incident face)."""
    return faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("v"), "f")


def euler_char(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, nv, ne, nf, chi; every vertex counts, also isolated ones."""
    nv = vertices.groupBy("mesh_id").agg(F.count("*").alias("nv"))
    ne = edges(faces).groupBy("mesh_id").agg(F.count("*").alias("ne"))
    nf = faces.groupBy("mesh_id").agg(F.count("*").alias("nf"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return nv.join(ne, "mesh_id", "left").join(nf, "mesh_id", "left").select(
        "mesh_id", "nv", zero("ne"), zero("nf")
    ).withColumn("chi", F.col("nv") - F.col("ne") + F.col("nf"))


def genus0_gate(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Ids of meshes with Euler characteristic 2, to be used in a left-semi join before costly work."""
    return euler_char(vertices, faces).where("chi = 2").select("mesh_id")


def bbox(vertices: DataFrame) -> DataFrame:
    ext = []
    for k in "xyz":
        ext += [F.min(k).alias("lo" + k), F.max(k).alias("hi" + k)]
    box = vertices.groupBy("mesh_id").agg(*ext)
    return box.withColumn("diag", norm(sub(vec("hi"), vec("lo"))))


def bbox_diagonal(vertices: DataFrame) -> DataFrame:
    return bbox(vertices).select("mesh_id", "diag")


def normalize_bbox(vertices: DataFrame) -> DataFrame:
    """Centre every mesh on its box and scale the box diagonal to 1 (a point keeps scale 1)."""
    d = F.when(F.col("diag") > 0, F.col("diag")).otherwise(F.lit(1.0))
    mid = tuple((F.col("lo" + k) + F.col("hi" + k)) / 2 for k in "xyz")
    return vertices.join(bbox(vertices), "mesh_id").select(
        "mesh_id", "v", *named(scale(sub(vec(""), mid), 1 / d), ""))


def strip_to_cloud(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("mesh_id").alias("cloud_id"), F.col("v").alias("p"), "x", "y", "z")


def rms_radius(vertices: DataFrame, key: str = "mesh_id") -> DataFrame:
    return vertices.groupBy(key).agg(F.sqrt(F.avg(dot(vec(""), vec("")))).alias("r"))


def weld(corners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge equal coordinates of corners(mesh_id, f, k, x, y, z) in first-seen order.

    Returns (vertices, faces). -0.0 equals 0.0 in both grouping and joins. Numbers come
    from blocks of the first-use ordinal, so one big mesh is not ranked in one task.
    """
    rows = corners.select(
        "mesh_id", "f", "k", (3 * F.col("f") + F.col("k")).alias("ord"),
        *[(F.col(c) + F.lit(0.0)).alias(c) for c in "xyz"])
    first = rows.groupBy("mesh_id", "x", "y", "z").agg(F.min("ord").alias("ord"))
    verts = number_by_ordinal(first, ["mesh_id"], "ord", "v")
    ids = rows.drop("ord").join(verts.drop("ord"), ["mesh_id", "x", "y", "z"])
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    faces = ids.groupBy("mesh_id", "f").agg(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))
    return verts.select("mesh_id", "v", "x", "y", "z"), faces.select("mesh_id", "f", "a", "b", "c")


def first_use(faces: DataFrame) -> DataFrame:
    """Dense numbers of the used vertices in order of first use: (mesh_id, v, id)."""
    use = faces.select("mesh_id", "f", F.posexplode(F.array("a", "b", "c")).alias("k", "v")).groupBy("mesh_id", "v").agg(
        F.min(3 * F.col("f") + F.col("k")).alias("ord"))
    return number_by_ordinal(use, ["mesh_id"], "ord", "id").select("mesh_id", "v", "id")


def compact_points(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep only vertices some face uses, renumbered by first use."""
    ids = first_use(faces)
    kept = vertices.join(ids, ["mesh_id", "v"]).drop("v").withColumnRenamed("id", "v")
    out = faces
    for k in "abc":
        out = out.join(ids.select("mesh_id", F.col("v").alias(k), F.col("id").alias("_" + k)), ["mesh_id", k])
    return kept.select("mesh_id", "v", *[c for c in vertices.columns if c not in ("mesh_id", "v")]), out.select(
        "mesh_id", "f", *[F.col("_" + k).alias(k) for k in "abc"])


def canonical_triangles(faces: DataFrame, key: str = "mesh_id") -> DataFrame:
    """Distinct vertex triples regardless of order."""
    return faces.select(key, F.array_sort(F.array("a", "b", "c")).alias("tri")).distinct()


def triangle_set_overlap(one: DataFrame, two: DataFrame, key: str = "mesh_id") -> DataFrame:
    """Share of common canonical triangles, relative to the larger set."""
    def side(faces, n):
        tri = faces.select(key, F.array_sort(F.array("a", "b", "c")).alias("tri"))
        return tri.select(key, *[F.col("tri")[k].alias(f"t{k}") for k in range(3)], F.lit(n).alias("side"))

    # one aggregation of both sets: repeated triangles set the same bit
    per = side(one, 1).unionByName(side(two, 2)).groupBy(key, "t0", "t1", "t2").agg(F.bit_or("side").alias("s"))
    n = lambda cond: F.count_if(cond)
    out = per.groupBy(key).agg(
        n(F.col("s") == 3).alias("common"),
        n(F.col("s").isin(1, 3)).alias("n1"), n(F.col("s").isin(2, 3)).alias("n2"))
    return out.withColumn("overlap", F.col("common") / F.greatest("n1", "n2"))


def neighbour_mean(faces: DataFrame, chart: DataFrame) -> DataFrame:
    """Sum and count of the neighbours' chart vectors: (mesh_id, v, mx, my, mz, n)."""
    nb = chart.select("mesh_id", F.col("v").alias("u"), *[F.col("s" + k).alias("m" + k) for k in "xyz"])
    return adjacency(faces).join(nb, ["mesh_id", "u"]).groupBy("mesh_id", "v").agg(
        *[F.sum("m" + k).alias("m" + k) for k in "xyz"], F.count("*").alias("n"))


def numbered_edges(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with a new vertex id each: the vertex count of the mesh plus the order of first sight."""
    nv = vertices.groupBy("mesh_id").agg(F.count("*").alias("nv"))
    e = number_by_ordinal(edges(faces), ["mesh_id"], "ord", "_place").join(nv, "mesh_id")
    return e.select("mesh_id", "lo", "hi", "n", "opp1", "opp2", (F.col("nv") + F.col("_place")).alias("id"))
