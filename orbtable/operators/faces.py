"""Per-face measures of a mesh and its chart, and what they add up to.

Functions take the frame of mesh.charted_corners (positions ax..cz, chart asx..csz)
where they need coordinates, so one gather serves many measures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orbtable.functions import geometry as g
from orbtable.functions.vec import add, cross, dot, fence, named, norm, scale, sub, vec
from orbtable.operators.mesh import half_edges
from orbtable.operators.rank import order_statistics
from orbtable.session import settle


def _pos():
    return vec("a"), vec("b"), vec("c")


def _chart():
    return vec("as"), vec("bs"), vec("cs")


def face_areas(frame: DataFrame, chart: bool = False) -> DataFrame:
    return frame.select("mesh_id", "f", g.tri_area(*(_chart() if chart else _pos())).alias("area"))


def surface_area(frame: DataFrame) -> DataFrame:
    return frame.groupBy("mesh_id").agg(F.count("*").alias("nf"), F.sum(g.tri_area(*_pos())).alias("area"))


def collapsed_faces(areas: DataFrame, reference: DataFrame, share: float = 0.1) -> DataFrame:
    """Faces whose area fell strictly below `share` of a positive reference area."""
    ref = reference.select("mesh_id", "f", F.col("area").alias("ref"))
    return areas.join(ref, ["mesh_id", "f"]).groupBy("mesh_id").agg(
        F.count_if((F.col("ref") > 0) & (F.col("area") < share * F.col("ref"))).alias("collapsed"),
        F.count("*").alias("nf"))


def volume_signs(frame: DataFrame) -> DataFrame:
    return frame.select("mesh_id", "f", "a", "b", "c", F.signum(g.signed_volume(*_chart())).alias("sg"))


def majority(frame: DataFrame) -> DataFrame:
    """(mesh_id, nf, pos, neg, maj): the majority orientation; a tie counts as positive."""
    return _majority(volume_signs(frame))


def _majority(signs: DataFrame) -> DataFrame:
    m = signs.groupBy("mesh_id").agg(
        F.count("*").alias("nf"), F.count_if(F.col("sg") > 0).alias("pos"), F.count_if(F.col("sg") < 0).alias("neg"))
    return m.withColumn("maj", F.when(2 * F.col("pos") >= F.col("nf"), F.lit(1.0)).otherwise(F.lit(-1.0)))


def fold_count(frame: DataFrame) -> DataFrame:
    """Faces whose orientation is not the majority's; zero volume is a fold."""
    return _fold_count(volume_signs(frame))


def _fold_count(signs: DataFrame) -> DataFrame:
    agree = F.when(F.col("maj") > 0, F.col("pos")).otherwise(F.col("neg"))
    return _majority(signs).select("mesh_id", (F.col("nf") - agree).alias("folds"))


def folded_faces(frame: DataFrame) -> DataFrame:
    return volume_signs(frame).join(majority(frame).select("mesh_id", "maj"), "mesh_id").where("sg <> maj").select(
        "mesh_id", "f", "a", "b", "c")


def with_lambda(frame: DataFrame) -> DataFrame:
    """Conformal factor per face: chart area over surface area."""
    lam = g.tri_area(*_chart()) / F.greatest(g.tri_area(*_pos()), F.lit(g.TINY))
    return frame.withColumn("lam", lam)


def lambda_stats(frame: DataFrame) -> DataFrame:
    return _lambda_spread(with_lambda(frame))


def _lambda_spread(lam: DataFrame) -> DataFrame:
    return lam.groupBy("mesh_id").agg(
        (F.stddev_pop("lam") / F.avg("lam")).alias("spread"),
        (F.max("lam") / F.greatest(F.min("lam"), F.lit(g.TINY))).alias("ratio"))


def chart_roughness(frame: DataFrame) -> DataFrame:
    """Jump of log(lambda) across shared edges: mean, and the value at index floor(0.99 (n - 1)).

    The logarithm rides on the half-edges, so pairing faces is one aggregation by edge;
    edges with more than two faces compare every later face with the first.
    """
    return _roughness(with_lambda(frame))


def _roughness(lam: DataFrame) -> DataFrame:
    lam = lam.select("mesh_id", "f", "a", "b", "c", F.log(F.greatest("lam", F.lit(g.TINY))).alias("ll"))
    h = half_edges(lam, ["ll"]).select("mesh_id", F.least("u", "w").alias("lo"), F.greatest("u", "w").alias("hi"), "ord", "ll")
    key = ["mesh_id", "lo", "hi"]
    e = h.groupBy(*key).agg(F.count("*").alias("n"), F.max("ll").alias("top"), F.min("ll").alias("bot"))
    seen = Observation()
    jumps = settle(e.observe(seen, F.count_if(F.col("n") > 2).alias("many")).where("n = 2").select("mesh_id", (F.col("top") - F.col("bot")).alias("jump")), "jumps")
    if seen.get["many"]:
        many = h.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("ord", "ll")).alias("first")).where("n > 2").select(*key, "first")
        rest = h.join(many, key).where(F.col("ord") != F.col("first.ord")).select(
            "mesh_id", F.abs(F.col("ll") - F.col("first.ll")).alias("jump"))
        jumps = jumps.unionByName(rest)
    mean = jumps.groupBy("mesh_id").agg(F.avg("jump").alias("mean"))
    return order_statistics(jumps, ["mesh_id"], "jump", {"p99": ("floor", 0.99)}).join(mean, "mesh_id").select(
        "mesh_id", "mean", "p99")


def angle_error(frame: DataFrame) -> DataFrame:
    """Per face: largest angle difference between chart and surface, and the smallest chart angle (radians)."""
    a, b = g.tri_angles(*_pos()), g.tri_angles(*_chart())
    return fence(frame, ["mesh_id", "f"],
                 F.greatest(*[F.abs(s - t) for s, t in zip(a, b)]).alias("err"), F.least(*b).alias("min_angle"))


# fixed value: a spherical triangle with a smaller angle (radians) is a sliver
SLIVER_ANGLE = 0.05


def sliver_filter(frame: DataFrame) -> DataFrame:
    return angle_error(frame).where(F.col("min_angle") < SLIVER_ANGLE).select("mesh_id", "f", "min_angle")


def angle_distortion(frame: DataFrame) -> DataFrame:
    """median, p90, p99 and max of the angle error in degrees, and the sliver count."""
    err = angle_error(frame)
    q = order_statistics(err, ["mesh_id"], "err", {
        "median": ("floor", 0.5), "p90": ("floor", 0.9), "p99": ("floor", 0.99), "max": ("floor", 1.0)})
    sl = err.groupBy("mesh_id").agg(F.count_if(F.col("min_angle") < SLIVER_ANGLE).alias("slivers"), F.count("*").alias("nf"))
    deg = 180.0 / math.pi
    return q.join(sl, "mesh_id").select(
        "mesh_id", *[(F.col(c) * deg).alias(c) for c in ("median", "p90", "p99", "max")], "slivers", "nf")


def corner_rows(frame: DataFrame, *values: Column) -> DataFrame:
    """One row per (face, corner vertex) carrying the given per-face values."""
    return frame.select("mesh_id", *values, F.explode(F.array("a", "b", "c")).alias("v"))


def vertex_density(vertices: DataFrame, frame: DataFrame, chart: bool = True) -> DataFrame:
    """(valence + 1) / (share of incident area); isolated vertices take the smallest positive density."""
    area = g.tri_area(*(_chart() if chart else _pos())).alias("area")
    rows = corner_rows(frame, area)
    per = rows.groupBy("mesh_id", "v").agg(F.sum("area").alias("av"), F.count("*").alias("val"))
    total = frame.select("mesh_id", area).groupBy("mesh_id").agg(F.sum("area").alias("tot"))
    d = per.join(total, "mesh_id").where("av > 0").select(
        "mesh_id", "v", ((F.col("val") + 1) / (F.col("av") / F.col("tot"))).alias("d"))
    low = d.groupBy("mesh_id").agg(F.min("d").alias("dmin"))
    return vertices.select("mesh_id", "v").join(d, ["mesh_id", "v"], "left").join(low, "mesh_id", "left").select(
        "mesh_id", "v", F.coalesce("d", "dmin").alias("d"))


def face_to_vertex(frame: DataFrame, values: dict[str, Column], area: Column) -> DataFrame:
    """Area-weighted mean of per-face values at every used vertex."""
    rows = corner_rows(frame, area.alias("_w"), *[c.alias(k) for k, c in values.items()])
    w = F.sum("_w")
    w = F.when(w != 0, w).otherwise(F.lit(1.0))
    return rows.groupBy("mesh_id", "v").agg(*[(F.sum(F.col("_w") * F.col(k)) / w).alias(k) for k in values])


def vertex_population_density(frame: DataFrame) -> DataFrame:
    """rho at vertices for population = surface area: mean of surface area / chart area."""
    sa = g.tri_area(*_chart())
    rho = g.tri_area(*_pos()) / F.greatest(sa, F.lit(g.TINY))
    return face_to_vertex(frame, {"rho": rho}, sa)


def density_spread(density: DataFrame, value: str = "rho") -> DataFrame:
    return density.groupBy("mesh_id").agg((F.stddev_pop(value) / F.avg(value)).alias("spread"))


def face_gradient_columns(a, b, c, ga: Column, gb: Column, gc: Column):
    """Gradient vector of a linear function on a triangle with corner values ga, gb, gc."""
    n = cross(sub(c, b), sub(a, c))
    area2 = norm(n)
    area2 = F.when(area2 > 0, area2)  # a collapsed face has no gradient and no weight
    t = add(scale(sub(c, b), ga), scale(sub(a, c), gb), scale(sub(b, a), gc))
    return scale(cross(scale(n, 1 / area2), t), 1 / area2)


def density_velocity(frame: DataFrame, density: DataFrame) -> DataFrame:
    """-grad(rho)/rho at every vertex, projected to the tangent plane of the chart sphere.

    `frame` has chart corners; `density` is (mesh_id, v, rho).
    """
    gathered = frame
    for k in "abc":
        gathered = gathered.join(density.select("mesh_id", F.col("v").alias(k), F.col("rho").alias(k + "rho")), ["mesh_id", k])
    s = _chart()
    grad = face_gradient_columns(*s, F.col("arho"), F.col("brho"), F.col("crho"))
    at_v = face_to_vertex(gathered, dict(zip(("gx", "gy", "gz"), grad)), g.tri_area(*s))
    here = F.explode(F.array(*[
        F.struct(F.col(k).alias("v"), *[F.col(f"{k}s{x}").alias("s" + x) for x in "xyz"], F.col(k + "rho").alias("rho"))
        for k in "abc"]))
    own = gathered.select("mesh_id", here.alias("h")).select("mesh_id", "h.*").groupBy("mesh_id", "v").agg(
        *[F.any_value(c).alias(c) for c in ("sx", "sy", "sz", "rho")])
    d = tuple(-F.col("g" + k) / F.col("rho") for k in "xyz")
    out = at_v.join(own, ["mesh_id", "v"]).select("mesh_id", "v", "rho", "sx", "sy", "sz", *named(d, "d"))
    radial = dot(vec("d"), vec("s"))
    return out.select("mesh_id", "v", *named(sub(vec("d"), scale(vec("s"), radial)), "d"))


def most_regular_triangle(frame: DataFrame) -> DataFrame:
    """The most equilateral face of every mesh; the lowest index wins a tie."""
    r = frame.select("mesh_id", "f", g.irregularity(*_pos()).alias("reg"))
    return r.groupBy("mesh_id").agg(F.min(F.struct("reg", "f")).alias("m")).select("mesh_id", "m.f", "m.reg")


def regular_triangle_avg(frame: DataFrame, chart: bool = True) -> DataFrame:
    """The face whose corners have the smallest mean of irregularity / 3 summed over their faces."""
    reg = g.irregularity(*(_chart() if chart else _pos()))
    rv = corner_rows(frame, reg.alias("reg")).groupBy("mesh_id", "v").agg((F.sum("reg") / 3).alias("rv"))
    f = frame.select("mesh_id", "f", F.explode(F.array("a", "b", "c")).alias("v")).join(rv, ["mesh_id", "v"])
    per = f.groupBy("mesh_id", "f").agg((F.sum("rv") / 3).alias("reg"))
    return per.groupBy("mesh_id").agg(F.min(F.struct("reg", "f")).alias("m")).select("mesh_id", "m.f", "m.reg")


def centroid_columns(p=None):
    a, b, c = p or _chart()
    m = scale(add(a, b, c), F.lit(1.0) / 3)
    return scale(m, 1 / norm(m))


def antipodal_face(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    """The face whose centroid direction is farthest from that of the chosen face; lowest index wins a tie."""
    cen = frame.select("mesh_id", "f", *named(centroid_columns(), "c"))
    ref = cen.join(chosen.select("mesh_id", "f"), ["mesh_id", "f"]).select("mesh_id", *[F.col("c" + k).alias("r" + k) for k in "xyz"])
    d = sub(vec("c"), vec("r"))
    far = cen.join(ref, "mesh_id").select("mesh_id", "f", dot(d, d).alias("d2"))
    return far.groupBy("mesh_id").agg(F.max(F.struct("d2", (-F.col("f")).alias("nf"))).alias("m")).select(
        "mesh_id", (-F.col("m.nf")).alias("f"), F.col("m.d2").alias("d2"))


def rotation_of_face(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    """m0..m8 rotating the chosen face's centroid to the north pole, and its inverse i0..i8."""
    one = frame.join(chosen.select("mesh_id", "f"), ["mesh_id", "f"]).select("mesh_id", "f", *named(centroid_columns(), "c"))
    m = g.rotation_to_north(vec("c"))
    return one.select(
        "mesh_id", "f", *[e.alias(f"m{k}") for k, e in enumerate(m)],
        *[e.alias(f"i{k}") for k, e in enumerate(g.transpose3(m))])


def balanced_energy(frame: DataFrame, alpha: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Conformal/area energy of a chart and its tangential gradient per vertex.

    Returns (energy(mesh_id, energy), gradient(mesh_id, v, gx, gy, gz)). The energy of a
    chart with a folded or degenerate face is infinite. Faces are oriented by the majority.
    """
    a, b, c = _pos()
    area = g.tri_area(a, b, c)
    cot = g.cotangents(a, b, c, F.col("As"))
    tot = frame.select("mesh_id", area.alias("As")).groupBy("mesh_id").agg(F.sum("As").alias("At"))
    fr = frame.withColumn("As", area).join(tot, "mesh_id").join(majority(frame).select("mesh_id", "maj"), "mesh_id")
    fr = fr.withColumn("w", F.col("As") / F.col("At")).withColumn("sc", F.lit(4 * math.pi) / F.col("At"))
    fr = fr.select("*", *[k.alias("cot" + n) for k, n in zip(cot, "abc")])
    A, Bv, C = _chart()
    As, w, sc, maj = (F.col(k) for k in ("As", "w", "sc", "maj"))
    det = maj * g.signed_volume(A, Bv, C) / (2 * As)
    sq = lambda p: dot(p, p)
    fro = (F.col("cota") * sq(sub(C, Bv)) + F.col("cotb") * sq(sub(A, C)) + F.col("cotc") * sq(sub(Bv, A))) / (2 * As)
    fr = fr.withColumn("det", det).withColumn("fro", fro)
    det, fro = F.col("det"), F.col("fro")
    safe = F.when(det > 0, det)
    jn = safe / sc
    e = w * (alpha * fro / (2 * safe) + (1 - alpha) * 0.5 * (jn + 1 / jn))
    energy = fr.groupBy("mesh_id").agg(F.sum(e).alias("e"), F.count_if(~(det > 0)).alias("bad")).select(
        "mesh_id", F.when(F.col("bad") == 0, F.col("e")).otherwise(F.lit(float("inf"))).alias("energy"))

    # with s1 s2 = det and s1^2 + s2^2 = fro, the chain rule needs dE/dfro and dE/ddet per face
    kf = w * alpha / (2 * safe) / As
    kd = maj * w * (-alpha * fro / (2 * safe * safe) + (1 - alpha) * 0.5 * (1 / sc - sc / (safe * safe))) / (2 * As)
    fr = fr.withColumn("kf", kf).withColumn("kd", kd)
    kf, kd = F.col("kf"), F.col("kd")
    ca, cb, cc = F.col("cota"), F.col("cotb"), F.col("cotc")

    def corner(vcol, here, f1, e1, f2, e2, normal):
        gv = add(scale(sub(scale(e1, f1), scale(e2, f2)), kf), scale(normal, kd))
        return F.struct(F.col(vcol).alias("v"), *[h.alias("s" + k) for h, k in zip(here, "xyz")],
                        *[x.alias("g" + k) for x, k in zip(gv, "xyz")])

    cb_, ac_, ba_ = sub(C, Bv), sub(A, C), sub(Bv, A)
    rows = F.inline(F.array(
        corner("a", A, cb, ac_, cc, ba_, cross(Bv, C)),
        corner("b", Bv, cc, ba_, ca, cb_, cross(C, A)),
        corner("c", C, ca, cb_, cb, ac_, cross(A, Bv)),
    ))
    per = fr.select("mesh_id", rows).groupBy("mesh_id", "v").agg(
        *[F.any_value("s" + k).alias("s" + k) for k in "xyz"], *[F.sum("g" + k).alias("g" + k) for k in "xyz"])
    grad = per.select("mesh_id", "v", *named(sub(vec("g"), scale(vec("s"), dot(vec("g"), vec("s")))), "g"))
    return energy, grad


def area_precond(frame: DataFrame) -> DataFrame:
    """Incident chart area over incident surface share per vertex."""
    rows = corner_rows(frame, g.tri_area(*_chart()).alias("sa"), g.tri_area(*_pos()).alias("pa"))
    tot = frame.select("mesh_id", g.tri_area(*_pos()).alias("pa")).groupBy("mesh_id").agg(F.sum("pa").alias("tot"))
    return rows.groupBy("mesh_id", "v").agg(F.sum("sa").alias("sa"), F.sum("pa").alias("pa")).join(tot, "mesh_id").select(
        "mesh_id", "v", (F.col("sa") / (F.col("pa") / F.col("tot"))).alias("h"))


def mobius_objective(frame: DataFrame, params: DataFrame) -> DataFrame:
    """Mean |log(area ratio)| of every candidate Moebius map of every mesh: a candidate scan in one plan.

    `params` is (param_id, k0..k7), a table of a few dozen rows whose size is checked here;
    the candidates ride on the faces as an array, so the expansion needs no join of tables.
    """
    rows = params.select("param_id", *[f"k{i}" for i in range(8)]).limit(MAX_CANDIDATES + 1).collect()
    if len(rows) > MAX_CANDIDATES:
        raise ValueError(f"mobius_objective takes at most {MAX_CANDIDATES} candidates per call; split the table")
    cand = F.array(*[
        F.struct(F.lit(r[0]).alias("param_id"), *[F.lit(float(r[1 + i])).alias(f"k{i}") for i in range(8)]) for r in rows])
    share = g.tri_area(*_pos())
    flat = frame.select(
        "mesh_id", "f", share.alias("pa"),
        *[c.alias(k + x) for k in "abc" for c, x in zip(g.stereo_north(vec(k + "s")), "uv")])
    total = flat.groupBy("mesh_id").agg(F.sum("pa").alias("pt"))
    each = flat.select("*", F.inline(cand))
    k = [F.col(f"k{i}") for i in range(8)]
    # staged, so that each intermediate is one column instead of a repeated subtree
    flat2 = [c for corner in "abc" for c in g.mobius(F.col(corner + "u"), F.col(corner + "v"), k)]
    each = fence(each, ["mesh_id", "param_id", "pa"], *[c.alias(n) for c, n in zip(flat2, ("ap", "aq", "bp", "bq", "cp", "cq"))])
    moved = [g.unstereo(F.col(c + "p"), F.col(c + "q")) for c in "abc"]
    each = fence(each, ["mesh_id", "param_id", "pa"], *[x.alias(c + "m" + d) for c, m in zip("abc", moved) for x, d in zip(m, "xyz")])
    each = each.select("mesh_id", "param_id", "pa", g.tri_area(vec("am"), vec("bm"), vec("cm")).alias("sa"))
    sums = each.groupBy("mesh_id", "param_id").agg(F.sum("sa").alias("st"))
    q = F.col("sa") / F.col("st") / (F.col("pa") / F.col("pt"))
    good = (F.col("sa") > 0) & (F.col("pa") > 0) & (F.col("st") > 0)
    return each.join(sums, ["mesh_id", "param_id"]).join(total, "mesh_id").groupBy("mesh_id", "param_id").agg(
        F.avg(F.when(good, F.abs(F.log(F.when(good, q))))).alias("obj"))


# fixed value: bound on the candidate list of one scan
MAX_CANDIDATES = 512


def mobius_best(objective: DataFrame) -> DataFrame:
    return objective.where("obj IS NOT NULL").groupBy("mesh_id").agg(F.min(F.struct("obj", "param_id")).alias("m")).select(
        "mesh_id", "m.param_id", "m.obj")


def chart_report(frame: DataFrame, kind: str = "given", crowded_at: float = 1e4) -> DataFrame:
    """One row per mesh: map type, lambda statistics, folds, roughness and the crowding flag.

    The corners are gathered once: every measure is taken from lambda and the orientation of each face.
    """
    slim = settle(with_lambda(frame).select("mesh_id", "f", "a", "b", "c", "lam", F.signum(g.signed_volume(*_chart())).alias("sg")), "measured")
    return (
        _lambda_spread(slim).join(_fold_count(slim), "mesh_id").join(_roughness(slim), "mesh_id")
        .select("mesh_id", F.lit(kind).alias("type"), "spread", "ratio", "folds",
                F.col("mean").alias("rough_mean"), F.col("p99").alias("rough_p99"),
                (F.col("ratio") > crowded_at).alias("crowded"))
    )


# fixed values: longest arc of a face piece and of a line piece (radians), and their limits
ARC_TARGET = 0.06
LINE_ARC = ARC_TARGET / 4
MAX_DEPTH = 5
MAX_PIECES = 256


def arc_depth(frame: DataFrame) -> DataFrame:
    """Per face: longest chart arc, the midpoint rounds that bring it below the target, and pieces per edge."""
    a, b, c = _chart()
    longest = F.greatest(g.arc(a, b), g.arc(b, c), g.arc(c, a))
    pieces = lambda p, q: F.least(F.lit(MAX_PIECES), F.greatest(F.lit(1), F.ceil(g.arc(p, q) / LINE_ARC))).cast("int")
    depth = F.lit(MAX_DEPTH)
    for k in range(MAX_DEPTH - 1, -1, -1):
        depth = F.when(longest <= ARC_TARGET * 2**k, F.lit(k)).otherwise(depth)
    return frame.select(
        "mesh_id", "f", longest.alias("arc"), depth.alias("depth"),
        pieces(a, b).alias("seg_ab"), pieces(b, c).alias("seg_bc"), pieces(c, a).alias("seg_ca"))
