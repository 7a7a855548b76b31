"""Superstep jobs: all meshes advance together, every round is written, finished meshes drop out.

Linear systems are solved over a hierarchy of coarser graphs (`multilevel`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from orbtable.functions import geometry as g
from orbtable.functions.vec import add, dot, named, norm, scale, sub, unit_columns, vec
from orbtable.operators import faces as fo, matrices as mx, warp
from orbtable.operators.chart import puncture_balance
from orbtable.operators.mesh import adjacency, charted_corners, face_corners, half_edges, vertex_faces
from orbtable.operators.multilevel import COARSE, solve_systems
from orbtable.operators.rank import lowest_share
from orbtable.operators.spatial import locate, pl_interpolate
from orbtable.operators.walk import face_patches, locate_from
from orbtable.session import scratch_path, settle

S = ["sx", "sy", "sz"]


def chart_corners(faces: DataFrame, chart: DataFrame) -> DataFrame:
    return face_corners(faces, chart, S)


def fold_grow(bad_faces: DataFrame, adj: DataFrame) -> DataFrame:
    """Vertices of folded faces plus one ring."""
    touch = bad_faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    ring = adj.join(touch, ["mesh_id", "v"], "leftsemi").select("mesh_id", F.col("u").alias("v"))
    return touch.unionByName(ring).distinct()


def _neighbour_sum(adj: DataFrame, chart: DataFrame) -> DataFrame:
    nb = chart.select("mesh_id", F.col("v").alias("u"), *[F.col(c).alias("m" + c) for c in S])
    return adj.join(nb, ["mesh_id", "u"]).groupBy("mesh_id", "v").agg(F.count("*").alias("n"), *[F.sum("m" + c).alias("m" + c) for c in S])


def smooth_chart(faces: DataFrame, chart: DataFrame, rounds: int, alpha: float = 0.5) -> DataFrame:
    """Rounds of (1 - alpha) own + alpha * neighbour mean, back on the sphere after each."""
    adj = settle(adjacency(faces), "adj")
    for _ in range(rounds):
        j = chart.join(_neighbour_sum(adj, chart), ["mesh_id", "v"], "left")
        mixed = tuple(F.when(F.col("n").isNull(), F.col(c)).otherwise((1 - alpha) * F.col(c) + alpha * F.col("m" + c) / F.col("n")) for c in S)
        chart = settle(j.select("mesh_id", "v", *unit_columns(mixed, "s")), "smooth")
    return chart


def _overlay(chart: DataFrame, moved: DataFrame | None) -> DataFrame:
    """The chart with the newest position of every vertex that was moved."""
    if moved is None:
        return chart.select("mesh_id", "v", *S)
    late = moved.select("mesh_id", "v", *[F.col(c).alias("n" + c) for c in S])
    return chart.join(late, ["mesh_id", "v"], "left").select("mesh_id", "v", *[F.coalesce("n" + c, c).alias(c) for c in S])


def _counted(df: DataFrame, label: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """A settled table and how many of its rows satisfy `what`, counted while they are written."""
    seen = Observation()
    out = settle(df.observe(seen, F.count_if(F.lit(True) if what is None else what).alias("n")), label)
    return out, seen.get["n"]


def repair_rounds(faces: DataFrame, chart: DataFrame, max_passes: int, adj: DataFrame | None = None) -> tuple[DataFrame, int, DataFrame, int]:
    """repair_folds that also returns the faces still folded and their number.

    A pass works on the frontier alone: the vertices around folded faces move, the faces that meet them are
    judged anew, and the count of positive faces per mesh is corrected by the difference. All
    faces of a mesh are judged again only where its majority turns. Vertices that never moved are
    written no more than once, at the end; meshes without folds have no rows in a pass.
    """
    adj = settle(adjacency(faces), "adj") if adj is None else adj
    majority = F.when(2 * F.col("pos") >= F.col("nf"), F.lit(1.0)).otherwise(F.lit(-1.0))
    folded = lambda signs, tally: signs.join(tally.select("mesh_id", "maj"), "mesh_id").where("sg <> maj").select("mesh_id", "f", "a", "b", "c")
    signs = settle(fo.volume_signs(chart_corners(faces, chart)), "signs")
    tally = settle(signs.groupBy("mesh_id").agg(F.count("*").alias("nf"), F.count_if(F.col("sg") > 0).alias("pos")).withColumn("maj", majority), "tally")
    bad, n = _counted(folded(signs, tally), "folded")
    moved, passes = None, 0
    key, was = ["mesh_id", "v"], ["o" + c for c in S]
    while n and passes < max_passes:
        passes += 1
        grown = settle(fold_grow(bad, adj), "grown")
        now = _overlay(chart, moved)
        sums = _neighbour_sum(adj.join(grown, key, "leftsemi"), now)
        step = now.join(sums, key).select(*key, *unit_columns(vec("ms"), "s"), *[F.col(c).alias("o" + c) for c in S], F.lit(passes).alias("pass"))
        moved = settle(step if moved is None else step.unionByName(moved.join(grown, key, "leftanti")), "moved")
        late = moved.select(*key, "pass", *[F.col(c).alias("n" + c) for c in S], *was)
        new = F.col("pass") == passes
        both = chart.join(late, key, "left").select(
            *key, *[F.coalesce("n" + c, c).alias(c) for c in S], *[F.coalesce(F.when(new, F.col("o" + c)), "n" + c, c).alias("o" + c) for c in S])
        hit = vertex_faces(faces).join(moved.where(new).select(*key), key, "leftsemi").select("mesh_id", "f").distinct()
        frame = face_corners(faces.join(hit, ["mesh_id", "f"], "leftsemi"), both, [*S, *was])
        volume = lambda pre: F.signum(g.signed_volume(*[vec(k + pre) for k in "abc"]))
        frame = settle(frame.select("mesh_id", "f", "a", "b", "c", volume("s").alias("sg"), volume("os").alias("was")), "signs")
        gained = frame.groupBy("mesh_id").agg((F.count_if(F.col("sg") > 0) - F.count_if(F.col("was") > 0)).alias("gained"))
        after = tally.join(gained, "mesh_id", "left").select(
            "mesh_id", "nf", (F.col("pos") + F.coalesce("gained", F.lit(0))).alias("pos"), F.col("maj").alias("before"))
        tally, turned = _counted(after.withColumn("maj", majority), "tally", F.col("maj") != F.col("before"))
        left = bad.join(frame.select("mesh_id", "f"), ["mesh_id", "f"], "leftanti").unionByName(folded(frame, tally))
        if turned:
            ids = tally.where("maj <> before").select("mesh_id")
            again = fo.volume_signs(chart_corners(faces.join(ids, "mesh_id", "leftsemi"), _overlay(chart, moved)))
            left = left.join(ids, "mesh_id", "leftanti").unionByName(folded(again, tally))
        bad, n = _counted(left, "folded")
    return (settle(_overlay(chart, moved), "repair") if passes else chart), passes, bad, n


def repair_folds(faces: DataFrame, chart: DataFrame, max_passes: int = 200) -> tuple[DataFrame, int]:
    """Replace the vertices of folded faces and one ring around by their normalised neighbour sum until no fold is left."""
    return repair_rounds(faces, chart, max_passes)[:2]


def adaptive_warp(vertices, faces, chart, grid_faces: DataFrame, dirs: DataFrame, rounds: int = 30, small: int | None = None) -> DataFrame:
    """Pull a grid mesh dirs(mesh_id, v, x, y, z) toward the vertex density of a charted mesh.

    A mesh with at most `small` (warp.SMALL) pairs of a face and a point is warped inside a task; the rounds of larger ones are joins.
    """
    small = warp.SMALL if small is None else small
    size = faces.groupBy("mesh_id").agg(F.count("*").alias("nf")).join(dirs.groupBy("mesh_id").agg(F.count("*").alias("np")), "mesh_id")
    size = settle(size.select("mesh_id", (F.col("nf") * F.col("np") > small).alias("large")), "size")
    pick = lambda df, large: df.join(size.where("large" if large else "not large").select("mesh_id"), "mesh_id", "left_semi")
    own = lambda large: [pick(df, large) for df in (vertices, faces, chart, grid_faces, dirs)]
    out = _warp_in_tasks(*own(False), rounds)
    return out.unionByName(_warp_by_joins(*own(True), rounds)) if size.where("large").limit(1).count() else out


def _warp_in_tasks(vertices, faces, chart, grid_faces: DataFrame, dirs: DataFrame, rounds: int) -> DataFrame:
    none = lambda names, kind: [F.lit(None).cast(kind).alias(c) for c in names]
    part = lambda df, k, i, *cols: df.select("mesh_id", F.lit(k).alias("part"), F.col(i).alias("i"), *cols)
    d0 = fo.vertex_density(vertices, face_corners(faces, chart, S))
    verts = part(chart.join(d0, ["mesh_id", "v"]), 0, "v", *none("abc", "bigint"), *[F.col("s" + c).alias(c) for c in "xyz"], "d")
    rows = verts
    for k, df in ((1, faces), (2, grid_faces)):
        rows = rows.union(part(df, k, "f", *[F.col(c).cast("bigint") for c in "abc"], *none("xyzd", "double")))
    rows = rows.union(part(dirs, 3, "v", *none("abc", "bigint"), *"xyz", *none("d", "double")))
    return rows.groupBy("mesh_id").applyInPandas(lambda df: warp.warp_mesh(df, rounds), "mesh_id string, v bigint, x double, y double, z double")


def _warp_by_joins(vertices, faces, chart, grid_faces: DataFrame, dirs: DataFrame, rounds: int) -> DataFrame:
    """Points are located in full once; afterwards they walk from the face of the last round (`walk`)."""
    frame = face_corners(faces, chart, S)
    d0 = settle(fo.vertex_density(vertices, frame), "d0")
    ring = settle(half_edges(grid_faces).select("mesh_id", "u", "w"), "ring")
    patches = face_patches(faces, chart)
    p = dirs
    for k in range(rounds):
        as_chart = p.select("mesh_id", "v", *[F.col(c).alias("s" + c) for c in "xyz"])
        d2 = fo.vertex_density(p, face_corners(grid_faces, as_chart, S)).withColumnRenamed("d", "d2")
        asked = p.withColumnRenamed("v", "q")
        at = settle(locate_from(faces, chart, patches, asked) if k else locate(faces, chart, asked, label=False), "located")
        d = pl_interpolate(at, d0, ["d"]).withColumnRenamed("q", "v")
        r = d.join(d2, ["mesh_id", "v"]).select("mesh_id", "v", (F.col("d") / F.col("d2")).alias("r"))
        nb = p.join(r, ["mesh_id", "v"]).withColumnRenamed("v", "w")
        mean = ring.join(nb, ["mesh_id", "w"]).groupBy("mesh_id", F.col("u").alias("v")).agg(
            *[(F.sum(F.col("r") * F.col(c)) / F.sum("r")).alias(c) for c in "xyz"])
        last = at.select("mesh_id", F.col("q").alias("v"), "f")
        p = settle(mean.join(last, ["mesh_id", "v"], "left").select("mesh_id", "v", *unit_columns(vec(""), ""), "f"), "warp")
    return p.select("mesh_id", "v", "x", "y", "z")


# ------------------------------------------------------------------ linear systems


def jacobi_arrays(row: np.ndarray, col: np.ndarray, val: np.ndarray, b: np.ndarray, x: np.ndarray, tol: float, max_rounds: int) -> tuple[np.ndarray, float]:
    """(x, residual) of one system held as triplets, by the rounds of `_pcg_by_joins`; NaN is NULL there and left out of sums."""
    n, real = len(b), lambda a: a[~np.isnan(a)]
    total = lambda a: real(a).sum() if len(real(a)) else np.nan
    product = lambda p: np.bincount(row, np.nan_to_num(val * p[col]), n)
    d = np.bincount(row[row == col], val[row == col], n)
    d = np.where(d != 0, d, np.nan)
    size = np.sqrt(b @ b)
    r = b - product(x) if x.any() else b.copy()
    p = r / d
    for _ in range(max_rounds):
        rz, rn = total(r * (r / d)), np.sqrt(total(r * r))
        if not (rn > tol * size and rz > 0):
            break
        q = product(p)
        pq = total(p * q)
        al = rz / pq if pq != 0 else np.nan
        x, r = x + al * p, r - al * q
        p = r / d + total(r * (r / d)) / rz * p
    return x, np.sqrt(total(r * r)) / size if size > 0 else 0.0


def jacobi_pcg(matrix: DataFrame, rhs: DataFrame, cols: list[str], tol: float, max_rounds: int, start: DataFrame | None = None, small: int = COARSE) -> DataFrame:
    """Conjugate gradients with the diagonal as preconditioner, for every mesh and right-hand side at once.

    rhs(mesh_id, v, *cols) -> (mesh_id, v, comp, x, residual), residual = |r| / |b| of the system. Systems of at most
    `small` unknowns are solved inside a task each; larger ones advance together by joins.
    """
    size = settle(rhs.groupBy("mesh_id").agg((F.count("*") > small).alias("large")), "size")
    pick = lambda df, large: df if df is None else df.join(size.where("large" if large else "not large").select("mesh_id"), "mesh_id", "left_semi")
    part = lambda large: [pick(matrix, large), pick(rhs, large), cols, tol, max_rounds, pick(start, large)]
    out = _pcg_in_tasks(*part(False))
    return out.unionByName(_pcg_by_joins(*part(True))) if size.where("large").limit(1).count() else out


def _pcg_in_tasks(matrix: DataFrame, rhs: DataFrame, cols: list[str], tol: float, max_rounds: int, start: DataFrame | None) -> DataFrame:
    def solve(mat: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        diag = mat.loc[mat["row"] == mat["col"], "row"]
        given = given[given["v"].isin(diag)].sort_values("v", ignore_index=True)
        mat = mat[mat["row"].isin(given["v"]) & mat["col"].isin(given["v"])]
        row, col = (np.searchsorted(given["v"], mat[c]) for c in ("row", "col"))
        parts = []
        for c in cols if len(given) else []:
            x, residual = jacobi_arrays(row, col, mat["val"].to_numpy(), given[c].to_numpy(float), given["x_" + c].to_numpy(float), tol, max_rounds)
            parts.append(pd.DataFrame({"mesh_id": given["mesh_id"], "v": given["v"], "comp": c, "x": x, "residual": residual}))
        return pd.concat(parts) if parts else pd.DataFrame({"mesh_id": [], "v": [], "comp": [], "x": [], "residual": []})

    given = rhs.select("mesh_id", "v", *cols)
    if start is None:
        given = given.select("*", *[F.lit(0.0).alias("x_" + c) for c in cols])
    else:
        given = given.join(start.select("mesh_id", "v", *[F.col(c).alias("x_" + c) for c in cols]), ["mesh_id", "v"])
    given = settle(given, "rhs")  # the matrix may stem from the same table
    return matrix.select("mesh_id", "row", "col", "val").groupBy("mesh_id").cogroup(given.groupBy("mesh_id")).applyInPandas(
        solve, "mesh_id string, v bigint, comp string, x double, residual double")


def _pcg_by_joins(matrix: DataFrame, rhs: DataFrame, cols: list[str], tol: float, max_rounds: int, start: DataFrame | None) -> DataFrame:
    """Systems below `tol` take no further part in the products."""
    key = ["mesh_id", "comp"]
    scaled = F.try_divide("r", "d")  # NULL on a zero diagonal, and from there on: never converged
    long = lambda df, name: df.select("mesh_id", "v", F.inline(F.array(*[F.struct(F.lit(c).alias("comp"), F.col(c).alias(name)) for c in cols])))
    matrix = settle(matrix, "matrix")
    diag = matrix.where("row = col").select("mesh_id", F.col("row").alias("v"), F.col("val").alias("d"))
    st = long(rhs, "b").join(diag, ["mesh_id", "v"])
    product = lambda df, c, out: matrix.join(df.select("mesh_id", "comp", F.col("v").alias("col"), c), ["mesh_id", "col"]).groupBy(
        *key, F.col("row").alias("v")).agg(F.sum(F.col("val") * F.col(c)).alias(out))
    if start is None:
        st = st.withColumn("x", F.lit(0.0)).withColumn("r", F.col("b"))
    else:
        st = st.join(long(start, "x"), [*key, "v"])
        st = settle(st, "pcg")
        st = st.join(product(st, "x", "ax"), [*key, "v"]).withColumn("r", F.col("b") - F.col("ax")).drop("ax")
    st = settle(st.withColumn("p", scaled), "pcg")
    for _ in range(max_rounds):
        norms = st.groupBy(*key).agg(F.sum(F.col("r") * scaled).alias("rz"),
                                     F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("rn"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("bn"))
        live = settle(norms.where((F.col("rn") > tol * F.col("bn")) & (F.col("rz") > 0)).select(*key, "rz"), "live")
        if live.limit(1).count() == 0:
            break
        act = st.join(live, key)
        act = settle(act.join(product(act, "p", "q"), [*key, "v"]), "pcg")
        a = act.groupBy(*key).agg(F.try_divide(F.max("rz"), F.sum(F.col("p") * F.col("q"))).alias("al"))
        moved = act.join(a, key).withColumn("x", F.col("x") + F.col("al") * F.col("p")).withColumn("r", F.col("r") - F.col("al") * F.col("q"))
        beta = moved.groupBy(*key).agg(F.try_divide(F.sum(F.col("r") * scaled), F.max("rz")).alias("be"))
        nxt = moved.join(beta, key).withColumn("p", scaled + F.col("be") * F.col("p"))
        cols_kept = [*key, "v", "b", "d", "x", "r", "p"]
        st = settle(nxt.select(*cols_kept).unionByName(st.join(live, key, "leftanti").select(*cols_kept)), "pcg")
    fin = st.groupBy(*key).agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("rn"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("bn"))
    res = F.when(F.col("bn") > 0, F.col("rn") / F.col("bn")).otherwise(F.lit(0.0))
    return st.join(fin, key).select("mesh_id", "v", "comp", "x", res.alias("residual"))


def dirichlet_solve(matrix: DataFrame, vertices: DataFrame, fixed: DataFrame, cols: list[str], tol: float = 1e-11, max_rounds: int = 200,
                    coarse: int | None = None, whole: bool = True) -> DataFrame:
    """matrix x = 0 on the free vertices with fixed(mesh_id, v, *cols) prescribed; returns all vertices.

    A mesh without a solution is an error; without `whole` it is NaN on its free vertices.
    """
    pin = fixed.select("mesh_id", "v", *cols)
    free = vertices.select("mesh_id", "v").join(pin.select("mesh_id", "v"), ["mesh_id", "v"], "leftanti")
    row_free = matrix.join(free.withColumnRenamed("v", "row"), ["mesh_id", "row"], "leftsemi")
    inner = row_free.join(free.withColumnRenamed("v", "col"), ["mesh_id", "col"], "leftsemi")
    push = row_free.join(pin.withColumnRenamed("v", "col"), ["mesh_id", "col"]).groupBy("mesh_id", F.col("row").alias("v")).agg(
        *[(-F.sum(F.col("val") * F.col(c))).alias(c) for c in cols])
    rhs = free.join(push, ["mesh_id", "v"], "left").select("mesh_id", "v", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])
    return solve_systems(inner, rhs, cols, tol, max_rounds, coarse=coarse, whole=whole).unionByName(pin)


# ------------------------------------------------------------------ planar maps to the sphere


def _negated(m: DataFrame) -> DataFrame:
    return m.withColumn("val", -F.col("val"))


def _pins(faces: DataFrame, big: DataFrame, places: list[tuple[Column, Column]], frame: DataFrame) -> DataFrame:
    row = lambda k, p: F.struct(F.col(k).alias("v"), p[0].alias("u"), p[1].alias("w"))
    return frame.join(big.select("mesh_id", "f"), ["mesh_id", "f"]).select(
        "mesh_id", F.inline(F.array(*[row(k, p) for k, p in zip("abc", places)])))


def tutte_map(vertices: DataFrame, faces: DataFrame, big: DataFrame) -> DataFrame:
    """Harmonic map with uniform weights and the triangle big(mesh_id, f) pinned on the unit circle."""
    turn = [(F.lit(float(np.cos(2 * np.pi * k / 3))), F.lit(float(np.sin(2 * np.pi * k / 3)))) for k in range(3)]
    plane = dirichlet_solve(_negated(mx.tutte_laplacian(faces)), vertices, _pins(faces, big, turn, faces), ["u", "w"])
    return puncture_balance(faces, settle(plane, "plane"), big)


def harmonic_map(vertices: DataFrame, faces: DataFrame, big: DataFrame) -> DataFrame:
    """Cotangent version; the third pin keeps the shape of the puncture.

    Meshes whose cotangent system has no solution (singular or indefinite, as by collapsed faces) get the uniform map, as in the
    reference; one that is only not solved yet, or has no uniform map either, is an error.
    """
    frame = face_corners(faces, vertices, ["x", "y", "z"])
    p, q = sub(vec("b"), vec("a")), sub(vec("c"), vec("a"))
    la, lb = norm(p), norm(q)
    along = F.abs(dot(p, q)) / (la * la)
    up = 2 * g.tri_area(vec("a"), vec("b"), vec("c")) / (la * la)
    places = [(F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(0.0)), (along, up)]
    plane = settle(dirichlet_solve(_negated(mx.cot_laplacian(frame)), vertices, _pins(faces, big, places, frame), ["u", "w"], whole=False), "plane")
    out = settle(puncture_balance(faces, plane, big), "harmonic")
    bad = settle(out.where(F.isnan(F.col("sx") + F.col("sy") + F.col("sz")) | (F.col("sx") + F.col("sy") + F.col("sz")).isNull()).select("mesh_id").distinct(), "failed")
    if bad.limit(1).count() == 0:
        return out
    redo = lambda df: df.join(bad, "mesh_id", "leftsemi")
    return out.join(bad, "mesh_id", "leftanti").unionByName(tutte_map(redo(vertices), redo(faces), redo(big)))


def qc_correct(vertices: DataFrame, faces: DataFrame, chart: DataFrame) -> DataFrame:
    """Quasi-conformal correction in the south-pole plane with the lowest tenth held.

    Meshes whose solve fails try five times as many landmarks, and keep their map if that fails too.
    """
    u, w = g.stereo_south(vec("s"))
    plane = settle(chart.select("mesh_id", "v", u.alias("u"), w.alias("w")), "plane")
    frame = settle(face_corners(faces, vertices.join(plane, ["mesh_id", "v"]), ["x", "y", "z", "u", "w"]), "frame")
    # a face at the projection pole has no place in the plane
    flat = frame.where(F.abs(F.col("au") + F.col("bu") + F.col("cu")) < float("inf"))
    mat = settle(mx.beltrami_triplets(flat, mx.beltrami_coeff(flat, "u", "w"), "u", "w"), "mu")

    def attempt(ids: DataFrame | None, times: int) -> DataFrame:
        pick = (lambda df: df) if ids is None else (lambda df: df.join(ids, "mesh_id", "leftsemi"))
        k = F.least(F.col("n"), times * F.greatest(F.floor(F.col("n") / 10 + 0.5), F.lit(3)))
        held = lowest_share(pick(chart), ["mesh_id"], "sz", "v", k).select("mesh_id", "v")
        top = pick(plane).where(~(F.abs(F.col("u")) < float("inf")))
        pins = pick(plane).join(held, ["mesh_id", "v"], "leftsemi").join(top.select("mesh_id", "v"), ["mesh_id", "v"], "leftanti")
        body = pick(vertices).join(top.select("mesh_id", "v"), ["mesh_id", "v"], "leftanti")
        return settle(dirichlet_solve(pick(mat), body, pins, ["u", "w"], whole=False).unionByName(top.select("mesh_id", "v", "u", "w")), "qc")

    # the pole vertex is legitimately infinite: it is no sign of failure
    failed = lambda df: df.where(F.isnan("u") | F.isnan("w") | F.col("u").isNull()).select("mesh_id").distinct()
    one = attempt(None, 1)
    bad1 = settle(failed(one), "failed")
    good = one.join(bad1, "mesh_id", "leftanti")
    if bad1.limit(1).count():
        two = attempt(bad1, 5)
        bad2 = settle(failed(two), "failed")
        good = good.unionByName(two.join(bad2, "mesh_id", "leftanti")).unionByName(plane.join(bad2, "mesh_id", "leftsemi"))
    return good.select("mesh_id", "v", *named(g.unstereo(F.col("u"), F.col("w"), True), "s"))


# ------------------------------------------------------------------ density flow


def _candidate(cur: DataFrame, vel: DataFrame, short: DataFrame, dt: float, h: int) -> DataFrame:
    """Positions after step h of the list: nine halved steps, then five full ones capped by the shortest edge e at each vertex."""
    if h < 9:
        move = add(vec("s"), scale(vec("d"), F.lit(dt / 2**h)))
        return cur.join(vel, ["mesh_id", "v"]).select("mesh_id", "v", *unit_columns(move, "s"))
    far, limit = dt * norm(vec("d")), 0.3 / 2 ** (h - 9) * F.col("e")
    move = add(vec("s"), scale(vec("d"), dt * F.when(far > limit, limit / far).otherwise(F.lit(1.0))))
    return cur.join(vel, ["mesh_id", "v"]).join(short, ["mesh_id", "v"]).select("mesh_id", "v", *unit_columns(move, "s"))


def _shortest_edges(frame: DataFrame) -> DataFrame:
    """Shortest chart edge e at every vertex."""
    edge = half_edges(frame, [k + c for k in "abc" for c in S])
    side = lambda p, q: norm(sub(vec(p + "s"), vec(q + "s")))
    length = F.when(F.col("k") == 0, side("a", "b")).when(F.col("k") == 1, side("b", "c")).otherwise(side("c", "a"))
    return edge.select("mesh_id", F.explode(F.array("u", "w")).alias("v"), length.alias("e")).groupBy("mesh_id", "v").agg(F.min("e").alias("e"))


def density_equalise(vertices, faces, chart, dt: float = 0.1, eps: float = 1e-3, max_steps: int = 300,
                     max_rejected: int = 20, window: int = 100, gain: float = 0.9, mend_passes: int = 60) -> tuple[DataFrame, DataFrame]:
    """Move chart vertices down the gradient of surface area per chart area.

    Each step: repair folds, diffuse the density implicitly, and move by the first of fourteen candidates
    (`_candidate`) that has no fold, or none after at most `mend_passes` passes of repair. A
    candidate is tried only on the meshes for which all before it failed. Returns (chart,
    log(mesh_id, step, spread, best, rejected, stopped)); step 0 is the start, and a mesh leaves
    when it converged, stalled or levelled off.
    """
    spark = chart.sparkSession
    log_path = scratch_path(spark, "log")
    adj = settle(adjacency(faces), "adj")
    cur = settle(chart.select("mesh_id", "v", *unit_columns(vec("s"), "s")), "flow")
    live = settle(chart.select("mesh_id").distinct(), "live")
    state = settle(live.select("mesh_id", F.lit(0).alias("rejected")), "state")
    done = []
    spread = fo.density_spread(fo.vertex_population_density(charted_corners(faces, vertices, cur)))
    for step in range(max_steps + 1):
        if step:
            f_live = faces.join(live, "mesh_id", "leftsemi")
            v_live = vertices.join(live, "mesh_id", "leftsemi")
            cur = repair_rounds(f_live, cur, 200, adj)[0]
            frame = settle(charted_corners(f_live, v_live, cur), "frame")
            rho0 = fo.vertex_population_density(frame)
            rhs = rho0.join(mx.lumped_mass(frame), ["mesh_id", "v"]).select("mesh_id", "v", (F.col("rho") * F.col("m")).alias("rho"))
            rho = settle(solve_systems(mx.mass_plus_laplacian(frame, dt), rhs, ["rho"], 1e-6, whole=True), "rho")
            vel = settle(fo.density_velocity(frame, rho), "velocity")
            spread = fo.density_spread(rho)
            waiting, taken = live, []
            for h in range(14):
                own = lambda df: df.join(waiting, "mesh_id", "leftsemi")
                cand = settle(_candidate(own(cur), vel, _shortest_edges(own(frame)), dt, h), "tried")
                mended, _, bad, n = repair_rounds(own(f_live), cand, mend_passes, adj)
                failed = settle(bad.select("mesh_id").distinct(), "failed")
                taken.append(mended.select("mesh_id", "v", *S).join(failed, "mesh_id", "leftanti"))
                waiting = failed
                if not n:
                    break
            moved = cur.select("mesh_id", "v", *S).join(waiting, "mesh_id", "leftsemi")
            for part in taken:
                moved = moved.unionByName(part)
            cur = settle(moved, "flow")
            state = settle(state.join(waiting.withColumn("failed", F.lit(True)), "mesh_id", "left").select(
                "mesh_id", F.when(F.col("failed"), F.col("rejected") + 1).otherwise(0).alias("rejected")), "state")
        row = spread.join(state, "mesh_id").select("mesh_id", F.lit(step).alias("step"), "spread", "rejected")
        row.write.mode("append").parquet(log_path)
        log = spark.read.schema(row.schema).parquet(log_path)
        judged = step_log(log, eps, max_rejected, window, gain).where(F.col("step") == step)
        leaving, n = _counted(judged.where("stopped IS NOT NULL").select("mesh_id"), "leaving")
        if n:
            done.append(settle(cur.join(leaving, "mesh_id", "leftsemi"), "done"))
            cur, state = settle(cur.join(leaving, "mesh_id", "leftanti"), "flow"), settle(state.join(leaving, "mesh_id", "leftanti"), "state")
            live, n = _counted(live.join(leaving, "mesh_id", "leftanti"), "live")
            if not n:
                break
    for d in done:
        cur = cur.unionByName(d)
    return cur, step_log(log, eps, max_rejected, window, gain)


def running_best(log: DataFrame, window: int = 100, gain: float = 0.9) -> DataFrame:
    """Step log with the best spread so far and whether it gained too little over the last `window` steps.

    The log of one mesh is as long as its step cap, so its window is bounded by that.
    """
    order = Window.partitionBy("mesh_id").orderBy("step")
    best = log.withColumn("best", F.min("spread").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("best", window).over(order)
    return best.withColumn("plateau", F.coalesce(F.col("best") > gain * before, F.lit(False)))


def step_log(log: DataFrame, eps: float, max_rejected: int, window: int, gain: float) -> DataFrame:
    """Adds the reason a mesh stops at a step, or NULL."""
    why = F.when(F.col("spread") < eps, "converged").when(F.col("rejected") >= max_rejected, "stalled").when(F.col("plateau"), "plateau")
    return running_best(log, window, gain).withColumn("stopped", why)


def energy_plateau(log: DataFrame, tol: float, lag: int = 50) -> DataFrame:
    """log(mesh_id, step, energy): true where the last `lag` steps gained less than tol * |energy|."""
    before = F.lag("energy", lag).over(Window.partitionBy("mesh_id").orderBy("step"))
    return log.withColumn("plateau", F.coalesce(before - F.col("energy") < tol * F.abs("energy"), F.lit(False)))
