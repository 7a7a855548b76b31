"""Generated surfaces, clouds and spectra; sizes, kinds and seeds come from rows of a table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbtable.session import settle
from orbtable.functions.vec import Vec, direction, named, norm, scale, vec
from orbtable.operators.mesh import half_edges, numbered_edges

# fixed value: turn between successive points of the golden spiral (radians)
GOLDEN_ANGLE = 2.399963229728653

# fixed values: the icosahedron, before normalising its vertices
GOLDEN = (1 + math.sqrt(5)) / 2
ICO_VERTICES = [
    (-1, GOLDEN, 0), (1, GOLDEN, 0), (-1, -GOLDEN, 0), (1, -GOLDEN, 0),
    (0, -1, GOLDEN), (0, 1, GOLDEN), (0, -1, -GOLDEN), (0, 1, -GOLDEN),
    (GOLDEN, 0, -1), (GOLDEN, 0, 1), (-GOLDEN, 0, -1), (-GOLDEN, 0, 1),
]
ICO_FACES = [
    (0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11),
    (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8),
    (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9),
    (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1),
]


# ------------------------------------------------------------------ lat-long meshes


def latlong_faces(meshes: DataFrame, nlat: Column, nphi: Column) -> DataFrame:
    """Faces of a lat-long mesh with pole vertices, by arithmetic on the face number (one row per mesh in)."""
    df = meshes.select("mesh_id", nlat.cast("bigint").alias("_nlat"), nphi.cast("bigint").alias("_nphi")).withColumn(
        "f", F.explode(F.sequence(F.lit(0).cast("bigint"), 2 * F.col("_nlat") * F.col("_nphi") - 1))
    )
    nlat, nphi, f = F.col("_nlat"), F.col("_nphi"), F.col("f")
    body = 2 * (nlat - 1) * nphi
    inside = f < body
    cell = F.when(inside, F.floor(f / 2)).otherwise(F.floor((f - body) / 2))
    first = f % 2 == 0
    df = df.withColumn("cell", cell.cast("bigint"))
    i = F.floor(F.col("cell") / nphi).cast("bigint")
    j = F.col("cell") % nphi
    j2 = (j + 1) % nphi
    a, b = i * nphi + j, i * nphi + j2
    c, d = a + nphi, b + nphi
    north, south, last = nlat * nphi, nlat * nphi + 1, (nlat - 1) * nphi
    pick = lambda in1, in2, cap1, cap2: (
        F.when(inside & first, in1).when(inside, in2).when(first, cap1).otherwise(cap2).cast("bigint")
    )
    return df.select(
        "mesh_id", "f",
        pick(a, b, north, last + j).alias("a"),
        pick(c, c, j, south).alias("b"),
        pick(b, d, j2, last + j2).alias("c"),
    )


def latlong_vertices(meshes: DataFrame, nlat: Column, nphi: Column, extra: list[str] = ()) -> DataFrame:
    """mesh_id, v, i, j, theta, phi for every vertex incl. the two poles (i = -1 and nlat)."""
    df = meshes.select("mesh_id", *extra, nlat.cast("bigint").alias("_nlat"), nphi.cast("bigint").alias("_nphi"))
    nlat, nphi, v = F.col("_nlat"), F.col("_nphi"), F.col("v")
    df = df.withColumn("v", F.explode(F.sequence(F.lit(0).cast("bigint"), nlat * nphi + 1)))
    grid = v < nlat * nphi
    i = F.when(grid, F.floor(v / nphi)).when(v == nlat * nphi, F.lit(-1)).otherwise(nlat).cast("int")
    df = df.withColumn("i", i).withColumn("j", F.when(grid, v % nphi).otherwise(F.lit(0)).cast("int"))
    return df.withColumn("theta", F.lit(math.pi) * (F.col("i") + 1) / (nlat + 1)).withColumn(
        "phi", F.lit(2 * math.pi) * F.col("j") / nphi
    ).drop("_nlat", "_nphi")


def shape(kind: Column, theta: Column, phi: Column) -> Vec:
    """Points of the test shapes: bumpy, ellipsoid, peanut, and the sphere for anything else."""
    st, ct = F.sin(theta), F.cos(theta)
    st2 = st * st
    bumpy = direction(theta, phi, 1 + 0.2 * st2 * st2 * F.cos(4 * phi) + 0.1 * F.cos(3 * theta))
    waist = 1 - 0.6 * st2
    peanut = (waist * st * F.cos(phi), waist * st * F.sin(phi), 1.4 * waist * ct)
    ellipsoid = (st * F.cos(phi), st * F.sin(phi), 3 * ct)
    ball = direction(theta, phi)
    return tuple(
        F.when(kind == "bumpy", b).when(kind == "ellipsoid", e).when(kind == "peanut", p).otherwise(s)
        for b, e, p, s in zip(bumpy, ellipsoid, peanut, ball))


def latlong_mesh(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """configs(mesh_id, nlat, nphi, kind) -> (vertices with x..z and exact chart sx..sz, faces)."""
    v = latlong_vertices(configs, F.col("nlat"), F.col("nphi"), ["kind"])
    th, ph = F.col("theta"), F.col("phi")
    return (
        v.select("mesh_id", "v", *named(shape(F.col("kind"), th, ph), ""), *named(direction(th, ph), "s")),
        latlong_faces(configs, F.col("nlat"), F.col("nphi")),
    )


# ------------------------------------------------------------------ tensor grid meshes


def tensor_faces(configs: DataFrame, wrap: bool = True) -> DataFrame:
    """Topology of a grid of nlat x nphi samples; caps close the poles when longitude wraps.

    Cap vertices follow the grid (first row's cap, then last row's); all faces of the first
    cap come before those of the last.
    """
    nlat, nphi, f = F.col("nlat").cast("bigint"), F.col("nphi").cast("bigint"), F.col("f")
    cols = nphi if wrap else nphi - 1
    body = 2 * (nlat - 1) * cols
    total = body + (2 * nphi if wrap else 0)
    df = configs.select("mesh_id", "nlat", "nphi", F.explode(F.sequence(F.lit(0).cast("bigint"), total - 1)).alias("f"))
    df = df.withColumn("part", F.when(f < body, 0).when(f < body + nphi, 1).otherwise(2))
    part = F.col("part")
    cell = F.floor(f / 2).cast("bigint")
    i = F.floor(cell / cols).cast("bigint")
    j = F.when(part == 0, cell % cols).otherwise((f - body) % nphi)
    j2 = (j + 1) % nphi
    a, b = i * nphi + j, i * nphi + j2
    c, d = a + nphi, b + nphi
    start, end, last = nlat * nphi, nlat * nphi + 1, (nlat - 1) * nphi
    odd = f % 2 == 1
    pick = lambda even_v, odd_v, cap1, cap2: F.when(part == 1, cap1).when(part == 2, cap2).when(odd, odd_v).otherwise(even_v).cast("bigint")
    return df.select("mesh_id", "f", pick(a, b, start, last + j).alias("a"), pick(c, c, j, end).alias("b"), pick(b, d, j2, last + j2).alias("c"))


def tensor_vertices(configs: DataFrame, rings: DataFrame) -> DataFrame:
    """Unit-sphere points of the grid of configs(mesh_id, nlat, nphi) on rings(nlat, i, ct, st), and the two caps."""
    g = configs.select("mesh_id", "nlat", "nphi").join(rings.select("nlat", "i", "ct", "st"), "nlat").withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("nphi") - 1)))
    phi = F.lit(2 * math.pi) * F.col("j") / F.col("nphi")
    grid = g.select("mesh_id", (F.col("i").cast("bigint") * F.col("nphi") + F.col("j")).alias("v"),
                    (F.col("st") * F.cos(phi)).alias("x"), (F.col("st") * F.sin(phi)).alias("y"), F.col("ct").alias("z"))
    n = F.col("nlat").cast("bigint") * F.col("nphi")
    cap = lambda v, z: F.struct(v.alias("v"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(z).alias("z"))
    return grid.unionByName(configs.select("mesh_id", F.inline(F.array(cap(n, 1.0), cap(n + 1, -1.0)))))


# ------------------------------------------------------------------ icosphere


def icosphere(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """configs(mesh_id, subdiv) -> (vertices, faces) of normalised midpoint subdivisions of the icosahedron."""
    corner = lambda k, t: F.struct(F.lit(k).cast("bigint").alias("v"), *[F.lit(float(x)).alias(c) for x, c in zip(t, "xyz")])
    tri = lambda k, t: F.struct(*[F.lit(x).cast("bigint").alias(c) for x, c in zip((k, *t), "fabc")])
    v = configs.select("mesh_id", "subdiv", F.inline(F.array(*[corner(k, t) for k, t in enumerate(ICO_VERTICES)])))
    v = v.select("mesh_id", "subdiv", "v", *named(scale(vec(""), 1 / norm(vec(""))), ""))
    f = configs.select("mesh_id", "subdiv", F.inline(F.array(*[tri(k, t) for k, t in enumerate(ICO_FACES)])))
    rounds = configs.agg(F.max("subdiv")).first()[0] or 0
    # written first: the planner takes a row that became twenty for one
    v, f = settle(v, "icosphere"), settle(f, "icosphere")
    for r in range(rounds):
        more = F.col("subdiv") > r
        fa, va = f.where(more), v.where(more)
        e = numbered_edges(fa, va)
        end = lambda k: va.select("mesh_id", F.col("v").alias(k), *[F.col(c).alias(k + c) for c in "xyz"])
        mid = e.join(end("lo"), ["mesh_id", "lo"]).join(end("hi"), ["mesh_id", "hi"])
        s = tuple(F.col("lo" + c) + F.col("hi" + c) for c in "xyz")
        levels = configs.select("mesh_id", "subdiv")
        new = mid.select("mesh_id", F.col("id").alias("v"), *named(scale(s, 1 / norm(s)), "")).join(levels, "mesh_id")
        split = split_faces(fa, e, [("a", "ab", "ca"), ("b", "bc", "ab"), ("c", "ca", "bc"), ("ab", "bc", "ca")]).join(levels, "mesh_id")
        # written each round: the next one reads both several times
        v, f = (settle(df, "icosphere") for df in (
            v.unionByName(new.select("mesh_id", "subdiv", "v", "x", "y", "z")),
            f.where(~more).unionByName(split.select("mesh_id", "subdiv", "f", "a", "b", "c"))))
    return v.drop("subdiv"), f.drop("subdiv")


def split_faces(faces: DataFrame, edge_ids: DataFrame, pattern: list[tuple[str, str, str]]) -> DataFrame:
    """Four faces per face from its corners a, b, c and edge vertices ab, bc, ca."""
    h = half_edges(faces).select("mesh_id", "f", "k", F.least("u", "w").alias("lo"), F.greatest("u", "w").alias("hi"), "u")
    j = h.join(edge_ids.select("mesh_id", "lo", "hi", "id"), ["mesh_id", "lo", "hi"])
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = j.groupBy("mesh_id", "f").agg(
        *[at(k, "u").alias(n) for k, n in enumerate("abc")], *[at(k, "id").alias(n) for k, n in enumerate(("ab", "bc", "ca"))])
    rows = [F.struct((4 * F.col("f") + k).alias("g"), *[F.col(n).alias(o) for n, o in zip(t, ("p", "q", "r"))]) for k, t in enumerate(pattern)]
    return wide.select("mesh_id", F.inline(F.array(*rows))).select(
        "mesh_id", F.col("g").alias("f"), F.col("p").alias("a"), F.col("q").alias("b"), F.col("r").alias("c"))


# ------------------------------------------------------------------ clouds and spectra


def golden_spiral(configs: DataFrame) -> DataFrame:
    """configs(cloud_id, n) -> n points on a golden spiral with radius 1 + 0.1 sin(3 theta) cos(4 phi)."""
    p = configs.select("cloud_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("p"))
    z = 1 - (2 * F.col("p") + 1) / F.col("n").cast("double")
    theta = F.acos(z)
    phi = F.pmod(F.col("p") * F.lit(GOLDEN_ANGLE), F.lit(2 * math.pi))
    return p.select("cloud_id", "p", *named(direction(theta, phi, 1 + 0.1 * F.sin(3 * theta) * F.cos(4 * phi)), ""))


def random_spectrum(seeds: DataFrame, lmax: int, mmax: int | None = None) -> DataFrame:
    """Uniform values in [-1, 1) per (field_id, l, m) from a hash of the seed; m = 0 is real."""
    mm = lmax if mmax is None else mmax
    unit = lambda part: F.pmod(F.xxhash64("l", "m", "seed", F.lit(part)), F.lit(1 << 32)) / float(1 << 32) * 2 - 1
    return (
        seeds.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(lmax))))
        .withColumn("m", F.explode(F.sequence(F.lit(0), F.least("l", F.lit(mm)))))
        .select("field_id", F.lit("v").alias("comp"), "l", "m", unit("re").alias("re"),
                F.when(F.col("m") == 0, 0.0).otherwise(unit("im")).alias("im"))
    )
