"""From a charted mesh to spectra, filtered surfaces, residuals, curvature and grid metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbtable.functions.vec import Vec, add, cross, dot, fence, named, norm, scale, sub, vec
from orbtable.operators import faces as fo, spectral as sp
from orbtable.operators.grids import is_finite
from orbtable.operators.mesh import bbox_diagonal, face_corners
from orbtable.operators.spatial import meridian_brackets, ring_brackets, self_intersections
from orbtable.operators.surface import resample
from orbtable.session import settle
from orbtable.sources.generate import tensor_faces

# fixed values: rings nearer the pole than this sine copy their neighbour; degenerate first fundamental form
RELIABLE_SIN = 0.2
DEGENERATE = 1e-12


def grid_directions(meshes: DataFrame, nlat: int, nphi: int) -> DataFrame:
    """(mesh_id, q, x, y, z): the Gauss grid directions for every mesh, q = i * nphi + j."""
    grid = sp.rings(meshes.sparkSession, nlat).select("i", "ct", "st").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nphi - 1))))
    phi = F.lit(2 * math.pi) * F.col("j") / nphi
    dirs = grid.select((F.col("i") * nphi + F.col("j")).cast("bigint").alias("q"),
                       *named((F.col("st") * F.cos(phi), F.col("st") * F.sin(phi), F.col("ct")), ""))
    ids = meshes.select("mesh_id").distinct().withColumn(
        "q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nlat * nphi - 1).cast("bigint"))))
    return ids.join(dirs, "q").select("mesh_id", "q", "x", "y", "z")


def resample_to_grid(vertices: DataFrame, faces: DataFrame, chart: DataFrame, nlat: int, nphi: int) -> DataFrame:
    """Surface points at the grid directions: (mesh_id, i, j, x, y, z)."""
    pts = resample(vertices, faces, chart, grid_directions(chart, nlat, nphi))
    return pts.select("mesh_id", F.floor(F.col("q") / nphi).cast("int").alias("i"), (F.col("q") % nphi).cast("int").alias("j"), "x", "y", "z")


def as_fields(grid: DataFrame) -> DataFrame:
    """Wide grid points to samples with one component per coordinate."""
    rows = F.array(*[F.struct(F.lit(k).alias("comp"), F.col(k).alias("f")) for k in "xyz"])
    return grid.select(F.col("mesh_id").alias("field_id"), "i", "j", F.inline(rows)).select("field_id", "comp", "i", "j", "f")


def as_points(samples: DataFrame, key: str = "mesh_id") -> DataFrame:
    """Samples of comps x, y, z back to one row per grid point."""
    return samples.groupBy(F.col("field_id").alias(key), "i", "j").agg(
        *[F.max(F.when(F.col("comp") == k, F.col("f"))).alias(k) for k in "xyz"])


def fit(vertices, faces, chart, nlat: int, nphi: int, lmax: int, refine: bool = False) -> tuple[DataFrame, DataFrame]:
    """(grid points, coefficients) of every mesh; both are written, as all filters reuse them."""
    grid = settle(resample_to_grid(vertices, faces, chart, nlat, nphi), "grid")
    analyse = sp.sh_refine if refine else sp.sh_analysis
    return grid, settle(analyse(as_fields(grid), nlat, nphi, lmax), "coeffs")


def filtered_rings(coeffs: DataFrame, gains: DataFrame, nlat: int, lmax: int) -> DataFrame:
    """(mesh_id, spec_id, i, x, y, z): the orders of every ring of every filtered surface, an array<struct<m, re, im>> a coordinate.

    A ring has lmax + 1 orders and many more points, so what has to move does so as orders; points are made after the last shuffle.
    """
    sep = "\u0001"
    f = sp.apply_gains(coeffs, gains).select(F.concat_ws(sep, "field_id", "spec_id").alias("field_id"), "comp", "l", "m", "re", "im")
    mode = F.struct("m", "re", "im")
    rings = sp.sh_legendre_synth(f, nlat, lmax).groupBy("field_id", "i").agg(*[F.collect_list(F.when(F.col("comp") == k, mode)).alias(k) for k in "xyz"])
    parts = F.split("field_id", sep)
    return rings.select(parts[0].alias("mesh_id"), parts[1].alias("spec_id"), "i", "x", "y", "z")


def filter_and_evaluate(coeffs: DataFrame, gains: DataFrame, nlat: int, nphi: int, lmax: int) -> DataFrame:
    """Filtered surfaces on the grid for every (mesh, filter spec) in one plan: (mesh_id, spec_id, i, j, x, y, z)."""
    return sp.expand_rings(filtered_rings(coeffs, gains, nlat, lmax), ["mesh_id", "spec_id", "i"], list("xyz"), nphi, lmax)


def filter_residuals(coeffs: DataFrame, gains: DataFrame, grid: DataFrame, vertices: DataFrame, nlat: int, nphi: int, lmax: int) -> DataFrame:
    """residual_metrics of filter_and_evaluate; whole rings meet the grid's, and points are made and measured where they meet."""
    exact = grid.groupBy("mesh_id", "i").agg(F.collect_list(F.struct("j", *[F.col(k).alias("e" + k) for k in "xyz"])).alias("exact"))
    rings = filtered_rings(coeffs, gains, nlat, lmax).join(exact, ["mesh_id", "i"])
    return _residuals(sp.expand_rings(rings, ["mesh_id", "spec_id"], list("xyz"), nphi, lmax, "exact"), vertices)


def residual_metrics(fitted: DataFrame, grid: DataFrame, vertices: DataFrame) -> DataFrame:
    """rms and maximum distance between fit and input on the grid, in percent of the box diagonal."""
    exact = grid.select("mesh_id", "i", "j", *[F.col(k).alias("e" + k) for k in "xyz"])
    return _residuals(fitted.join(exact, ["mesh_id", "i", "j"]), vertices)


def _residuals(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    d = sub(vec(""), vec("e"))
    r = pairs.select("mesh_id", "spec_id", dot(d, d).alias("d2"))
    m = r.groupBy("mesh_id", "spec_id").agg(F.sqrt(F.avg("d2")).alias("rms"), F.sqrt(F.max("d2")).alias("top"))
    return m.join(bbox_diagonal(vertices), "mesh_id").select(
        "mesh_id", "spec_id", (100 * F.col("rms") / F.col("diag")).alias("rms_pct"), (100 * F.col("top") / F.col("diag")).alias("max_pct"))


# ------------------------------------------------------------------ tensor meshes of the grid


def tensor_points(grid: DataFrame, nlat: int, nphi: int, key: str = "mesh_id") -> DataFrame:
    """Vertices of the grid's tensor mesh; each cap is the mean of its ring."""
    body = grid.select(key, (F.col("i").cast("bigint") * nphi + F.col("j")).alias("v"), "x", "y", "z")
    caps = grid.where(F.col("i").isin(0, nlat - 1)).groupBy(key, "i").agg(*[F.avg(k).alias(k) for k in "xyz"])
    cap_id = F.when(F.col("i") == 0, F.lit(nlat * nphi)).otherwise(F.lit(nlat * nphi + 1)).cast("bigint")
    return body.unionByName(caps.select(key, cap_id.alias("v"), "x", "y", "z"))


def morph_to_sphere(grid: DataFrame, nlat: int, nphi: int, morph: float) -> DataFrame:
    """Blend the tensor mesh toward the sphere of its rms radius: (mesh_id, v, x, y, z)."""
    pts = tensor_points(grid, nlat, nphi)
    r = grid.groupBy("mesh_id").agg(F.sqrt(F.avg(dot(vec(""), vec("")))).alias("rad"))
    ring = sp.rings(grid.sparkSession, nlat).select("i", "ct", "st")
    i = F.floor(F.col("v") / nphi).cast("int")
    phi = F.lit(2 * math.pi) * (F.col("v") % nphi) / nphi
    on_grid = F.col("v") < nlat * nphi
    j = pts.withColumn("i", i).join(ring, "i", "left").join(r, "mesh_id")
    pole = F.when(F.col("v") == nlat * nphi, 1.0).otherwise(-1.0)
    s = (F.when(on_grid, F.col("st") * F.cos(phi)).otherwise(0.0), F.when(on_grid, F.col("st") * F.sin(phi)).otherwise(0.0),
         F.when(on_grid, F.col("ct")).otherwise(pole))
    a = (1 - morph) * F.col("rad")
    return j.select("mesh_id", "v", *named(add(scale(s, a), scale(vec(""), morph)), ""))


def grid_metrics(fitted: DataFrame, grid: DataFrame, nlat: int, nphi: int) -> DataFrame:
    """Self-intersections and collapsed faces of the fitted tensor mesh against the input's: one row per mesh."""
    ids = grid.select("mesh_id").distinct().select("mesh_id", F.lit(nlat).alias("nlat"), F.lit(nphi).alias("nphi"))
    faces = settle(tensor_faces(ids), "tensor")
    pos, ref = settle(tensor_points(fitted, nlat, nphi), "fitted"), tensor_points(grid, nlat, nphi)
    area = lambda p: fo.face_areas(face_corners(faces, p, ["x", "y", "z"]))
    return self_intersections(pos, faces).join(fo.collapsed_faces(area(pos), area(ref)), "mesh_id").select(
        "mesh_id", "pairs", "collapsed", "nf")


# ------------------------------------------------------------------ curvature


def derivative_fields(coeffs: DataFrame, nlat: int, nphi: int, lmax: int) -> DataFrame:
    """sin-weighted derivatives of the three coordinates, wide: At, Att, Atp, xp, xpp each with _x, _y, _z.

    All fifteen fields are components of one synthesis.
    """
    at = sp.sin_dtheta_coeffs(coeffs)
    xp = sp.dphi_coeffs(coeffs)
    tag = lambda df, name: df.withColumn("comp", F.concat(F.lit(name + "_"), F.col("comp")))
    parts = [("At", at), ("Att", sp.sin_dtheta_coeffs(at)), ("Atp", sp.dphi_coeffs(at)), ("xp", xp), ("xpp", sp.dphi_coeffs(xp))]
    every = tag(parts[0][1], "At")
    for name, df in parts[1:]:
        every = every.unionByName(tag(df, name))
    s = sp.sh_synthesis(every, nlat, nphi, lmax)
    names = [f"{n}_{k}" for n, _ in parts for k in "xyz"]
    return s.groupBy("field_id", "i", "j").agg(*[F.max(F.when(F.col("comp") == c, F.col("f"))).alias(c) for c in names])


def pointwise_curvature(deriv: DataFrame, nlat: int) -> DataFrame:
    """Mean curvature h and Gauss curvature k at every grid point; NULL where the surface element vanishes."""
    v = lambda n: tuple(F.col(f"{n}_{k}") for k in "xyz")
    ring = sp.rings(deriv.sparkSession, nlat).select("i", "ct")
    At, Att, Atp, xp, xpp = v("At"), v("Att"), v("Atp"), v("xp"), v("xpp")
    n = cross(At, xp)
    d = deriv.join(ring, "i")
    d = d.select("*", *named(n, "n"), norm(n).alias("nn"), dot(At, At).alias("E"), dot(At, xp).alias("Fh"), dot(xp, xp).alias("G"))
    unit = scale(vec("n"), 1 / F.when(F.col("nn") > 0, F.col("nn")))
    second = sub(Att, scale(At, F.col("ct")))
    d = d.select("field_id", "i", "j", "E", "Fh", "G", dot(second, unit).alias("Lh"), dot(Atp, unit).alias("Mh"), dot(xpp, unit).alias("N"))
    E, Fh, G, Lh, Mh, N = (F.col(c) for c in ("E", "Fh", "G", "Lh", "Mh", "N"))
    W = E * G - Fh * Fh
    d = d.withColumn("W", F.when(W > DEGENERATE * E * G, W))
    W = F.col("W")
    return d.select("field_id", "i", "j", (-(E * N - 2 * Fh * Mh + G * Lh) / (2 * W)).alias("h"), ((Lh * N - Mh * Mh) / W).alias("k"))


def reliable_rows(rings: DataFrame) -> DataFrame:
    return rings.where(F.col("st") >= RELIABLE_SIN)


def cap_row_fill(field: DataFrame, nlat: int, cols: list[str]) -> DataFrame:
    """Rows too near a pole copy the nearest reliable ring, column by column.

    The nearest reliable ring depends only on the ring, so this is a join on two ring numbers.
    """
    ring = sp.rings(field.sparkSession, nlat).select("i", "st")
    good = ring.where(F.col("st") >= RELIABLE_SIN).agg(F.min("i").alias("first"), F.max("i").alias("last")).first()
    first, last = (good["first"], good["last"]) if good["first"] is not None else (nlat - 1, nlat - 1)
    src = field.select("field_id", F.col("i").alias("src"), "j", *cols)
    dst = field.select("field_id", "i", "j").withColumn("src", F.greatest(F.lit(first), F.least(F.lit(last), F.col("i"))))
    return dst.join(src, ["field_id", "src", "j"]).select("field_id", "i", "j", *cols)


def curvature(coeffs: DataFrame, nlat: int, nphi: int, lmax: int, kind: str = "h") -> DataFrame:
    """Band-limited curvature: pointwise on a grid of at least twice the band, then analysed and re-synthesised."""
    raw = cap_row_fill(pointwise_curvature(derivative_fields(coeffs, nlat, nphi, lmax), nlat), nlat, [kind])
    raw = settle(raw.select("field_id", "i", "j", F.col(kind).alias("raw")), "curv")
    ok = is_finite(F.col("raw"))
    clean = raw.select("field_id", F.lit("c").alias("comp"), "i", "j", F.when(ok, F.col("raw")).otherwise(0.0).alias("f"))
    proj = sp.sh_synthesis(sp.sh_analysis(clean, nlat, nphi, lmax), nlat, nphi, lmax)
    return raw.join(proj.drop("comp"), ["field_id", "i", "j"]).select("field_id", "i", "j", F.when(ok, F.col("f")).alias("f"))


def curvature_error(curv: DataFrame, value: str = "h", exact: float = 1.0) -> DataFrame:
    d = F.abs(F.col(value) - exact)
    return curv.groupBy("field_id").agg(F.sqrt(F.avg(d * d)).alias("rms"), F.max(d).alias("max"))


# ------------------------------------------------------------------ overlay curves


def curve_overlay_points(grid: DataFrame, coarse_nlat: int, coarse_nphi: int, nlat: int, nphi: int) -> DataFrame:
    """Points of the coarse grid's rings and meridians on a surface sampled on the finer grid.

    (mesh_id, kind, line, pos, x, y, z): rings are interpolated between rows, meridians between columns.
    """
    spark = grid.sparkSession
    one = F.lit(0).alias("grid")
    br = ring_brackets(sp.rings(spark, coarse_nlat).select(one, F.col("i").alias("r"), "theta"), sp.rings(spark, nlat).select(one, "i", "theta"))
    lines = spark.range(coarse_nphi).select(one, F.col("id").cast("int").alias("m"), F.lit(coarse_nphi).alias("nphi"))
    mb = meridian_brackets(lines, F.lit(nphi))

    def mix(brackets, key, ends, along, kind):
        end = lambda c, pre: grid.select("mesh_id", F.col(key).alias(c), along, *[F.col(k).alias(pre + k) for k in "xyz"])
        j = brackets.join(end(ends[0], "p"), ends[0]).join(end(ends[1], "q"), ["mesh_id", ends[1], along])
        w = F.col("w")
        line = "r" if kind == "ring" else "m"
        return j.select("mesh_id", F.lit(kind).alias("kind"), F.col(line).alias("line"), F.col(along).alias("pos"),
                        *named(add(scale(vec("p"), 1 - w), scale(vec("q"), w)), ""))

    return mix(br, "i", ("a", "b"), "j", "ring").unionByName(mix(mb, "j", ("c0", "c1"), "i", "meridian"))
