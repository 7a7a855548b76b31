"""Linear systems by conjugate gradients over a hierarchy of coarser graphs, built and applied by joins.

A level groups neighbouring unknowns, takes one smoothing step over the groups' indicator functions as its
interpolation P, and hands the smaller system P'AP down. A system of at most COARSE unknowns is
the end of its hierarchy and is solved inside a task; most meshes of a large table are that from the start.
Nothing larger is ever gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbtable.session import settle

#: Unknowns of a system that one task solves: about 230,000 triplets, 6 MB.
COARSE = 1 << 15
#: Weight of the damped Jacobi step that smooths residuals and interpolation.
DAMP = 2 / 3


@dataclass
class Level:
    """Systems with more than COARSE unknowns at this level, and how they go down."""

    columns: DataFrame  # mesh_id, col, entries array<struct<row, val>>
    diagonal: DataFrame  # mesh_id, v, d
    down: DataFrame  # mesh_id, v, c, w: interpolation from coarse unknown c to v
    direct: DataFrame  # triplets of the coarse systems that end here
    ended: DataFrame  # mesh_id of those, one row each


def _times(columns: DataFrame, x: DataFrame, cols: list[str], pre: str, out: str) -> DataFrame:
    """(mesh_id, v, out..) = matrix times the columns pre.. of x; partial sums are combined before they move."""
    met = columns.join(x.select("mesh_id", F.col("v").alias("col"), *[pre + c for c in cols]), ["mesh_id", "col"])
    each = met.select("mesh_id", F.explode("entries").alias("e"), *[pre + c for c in cols])
    return each.groupBy("mesh_id", F.col("e.row").alias("v")).agg(*[F.sum(F.col("e.val") * F.col(pre + c)).alias(out + c) for c in cols])


def group_neighbours(matrix: DataFrame, seed: int = 0) -> DataFrame:
    """(mesh_id, v, c): every unknown in the group of a root c.

    Roots are the unknowns whose hash exceeds those of all neighbours; they are independent, about one in seven of a
    triangle mesh. The rest join the group of a neighbour that has one, round by round; a
    component always has a root, so the rounds end.
    """
    edges = settle(matrix.where("row <> col AND val <> 0").select("mesh_id", F.col("row").alias("v"), F.col("col").alias("u")), "graph")
    key = lambda c: F.struct(F.xxhash64("mesh_id", c, F.lit(seed)).alias("h"), F.col(c).alias("i"))
    all_v = matrix.where("row = col").select("mesh_id", F.col("row").alias("v"))
    best = edges.groupBy("mesh_id", "v").agg(F.max(key("u")).alias("most"))
    state = all_v.join(best, ["mesh_id", "v"], "left").select("mesh_id", "v", F.when(F.col("most").isNull() | (key("v") > F.col("most")), F.col("v")).alias("c"))
    state = settle(state, "groups")
    while state.where("c IS NULL").limit(1).count():
        open_v = state.where("c IS NULL").select("mesh_id", "v")
        named = state.where("c IS NOT NULL").select("mesh_id", F.col("v").alias("u"), "c")
        offers = edges.join(open_v, ["mesh_id", "v"], "left_semi").join(named, ["mesh_id", "u"])
        taken = offers.groupBy("mesh_id", "v").agg(F.max(key("c"))["i"].alias("offer"))
        step = settle(state.join(taken, ["mesh_id", "v"], "left").select("mesh_id", "v", F.coalesce("c", "offer").alias("c")), "groups")
        if step.where("c IS NULL").count() == state.where("c IS NULL").count():
            return step.withColumn("c", F.coalesce("c", "v"))  # an unsymmetric pattern leaves some without an offer
        state = step
    return state


def interpolation(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """(mesh_id, v, c, w): the groups' indicator functions after one damped Jacobi step."""
    diag = matrix.where("row = col").select("mesh_id", F.col("row").alias("v"), F.col("val").alias("d"))
    met = matrix.join(groups.select("mesh_id", F.col("v").alias("col"), "c"), ["mesh_id", "col"])
    spread = met.groupBy("mesh_id", F.col("row").alias("v"), "c").agg(F.sum("val").alias("s"))
    spread = spread.join(diag, ["mesh_id", "v"]).select("mesh_id", "v", "c", (-DAMP * F.try_divide("s", "d")).alias("w"))
    both = groups.select("mesh_id", "v", "c", F.lit(1.0).alias("w")).unionByName(spread)
    return both.groupBy("mesh_id", "v", "c").agg(F.sum("w").alias("w")).where("w <> 0")


def coarse_matrix(matrix: DataFrame, down: DataFrame) -> DataFrame:
    """P'AP as two joins with sums."""
    right = matrix.join(down.select("mesh_id", F.col("v").alias("col"), F.col("c").alias("k"), "w"), ["mesh_id", "col"]).groupBy(
        "mesh_id", F.col("row").alias("v"), "k").agg(F.sum(F.col("val") * F.col("w")).alias("s"))
    return right.join(down, ["mesh_id", "v"]).groupBy("mesh_id", F.col("c").alias("row"), F.col("k").alias("col")).agg(
        F.sum(F.col("s") * F.col("w")).alias("val"))


def hierarchy(matrix: DataFrame, coarse: int | None = None) -> list[Level]:
    """Levels of all systems of `matrix` with more than `coarse` unknowns, until none is left above it."""
    coarse, levels, now = coarse or COARSE, [], settle(matrix.select("mesh_id", "row", "col", "val"), "level")
    while True:
        down = settle(interpolation(now, group_neighbours(now, len(levels))), "down")
        below = settle(coarse_matrix(now, down), "level")
        size = below.where("row = col").groupBy("mesh_id").agg(F.count("*").alias("n"))
        # a group of one or two cannot shrink a system for ever: what no longer halves ends here
        was = now.where("row = col").groupBy("mesh_id").agg(F.count("*").alias("m"))
        size = settle(size.join(was, "mesh_id"), "size")
        stuck = size.where((F.col("n") > coarse) & (2 * F.col("n") > F.col("m"))).select("mesh_id")
        if stuck.limit(1).count():
            raise ValueError("a system does not get smaller by grouping neighbours")
        ended = settle(size.where(F.col("n") <= coarse).select("mesh_id"), "ended")
        columns = settle(now.groupBy("mesh_id", "col").agg(F.collect_list(F.struct("row", "val")).alias("entries")), "columns")
        diagonal = settle(now.where("row = col").select("mesh_id", F.col("row").alias("v"), F.col("val").alias("d")), "diagonal")
        levels.append(Level(columns, diagonal, down, settle(below.join(ended, "mesh_id", "left_semi"), "direct"), ended))
        now = settle(below.join(ended, "mesh_id", "left_anti"), "level")
        if not now.limit(1).count():
            return levels


def pcg_arrays(row: np.ndarray, col: np.ndarray, val: np.ndarray, b: np.ndarray, tol: float = 1e-13, max_rounds: int | None = None) -> np.ndarray:
    """Conjugate gradients with the diagonal as preconditioner for one system held as triplets; NaN where it is not positive definite.

    Exact arithmetic needs n rounds at most; rounding is given ten times as many, and 5000 at least.
    """
    n = len(b)
    max_rounds = max(5000, 10 * n) if max_rounds is None else max_rounds
    d = np.bincount(row[row == col], val[row == col], n)
    x, r = np.zeros(n), b.copy()
    if not r.any():
        return x
    if (d <= 0).any():
        return np.full(n, np.nan)
    p, size, rz = r / d, np.sqrt(b @ b), r @ (r / d)
    for _ in range(max_rounds):
        q = np.bincount(row, val * p[col], n)
        if not p @ q > 0:
            return np.full(n, np.nan)
        step = rz / (p @ q)
        x, r = x + step * p, r - step * q
        if np.sqrt(r @ r) <= tol * size:
            break
        was, rz = rz, r @ (r / d)
        p = r / d + rz / was * p
    return x


def solve_direct(matrix: DataFrame, rhs: DataFrame, cols: list[str]) -> DataFrame:
    """(mesh_id, v, *cols, bad): systems of at most COARSE unknowns, a task for each, and the worst |b - matrix x| / |b| of the mesh."""
    def solve(mat: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("v", ignore_index=True)
        out = b.assign(bad=0.0)
        mat = mat[mat["row"].isin(b["v"]) & mat["col"].isin(b["v"])]
        row, col, val = np.searchsorted(b["v"], mat["row"]), np.searchsorted(b["v"], mat["col"]), mat["val"].to_numpy()
        for c in cols if len(b) else []:  # an empty right-hand side: this system is done
            want = b[c].to_numpy(float)
            x = pcg_arrays(row, col, val, want)
            miss = want - np.bincount(row, val * x[col], len(b))
            bad = np.sqrt(miss @ miss / max(want @ want, 1e-300))
            out[c], out["bad"] = x, np.maximum(out["bad"], bad if np.isfinite(bad) else np.inf)
        return out

    schema = "mesh_id string, v bigint, " + ", ".join(f"{c} double" for c in cols) + ", bad double"
    return matrix.select("mesh_id", "row", "col", "val").groupBy("mesh_id").cogroup(
        rhs.select("mesh_id", "v", *cols).groupBy("mesh_id")).applyInPandas(solve, schema)


def _each(cols: list[str], make) -> list[Column]:
    return [make(c) for c in cols]


def v_cycle(levels: list[Level], r: DataFrame, cols: list[str], at: int = 0) -> DataFrame:
    """(mesh_id, v, z..): an approximate solution for the residuals r.. of a written table, one smoothing step on either side of the coarse one."""
    level, on = levels[at], ["mesh_id", "v"]
    first = r.join(level.diagonal, on).select(*on, "d", *["r_" + c for c in cols], *_each(cols, lambda c: (DAMP * F.try_divide("r_" + c, "d")).alias("z_" + c)))
    left = first.join(_times(level.columns, first, cols, "z_", "a_"), on)
    left = left.select(*on, *_each(cols, lambda c: (F.col("r_" + c) - F.col("a_" + c)).alias("s_" + c)))
    rough = level.down.join(left, on).groupBy("mesh_id", F.col("c").alias("v")).agg(*_each(cols, lambda c: F.sum(F.col("w") * F.col("s_" + c)).alias("r_" + c)))
    rough = settle(rough, "coarse")
    plain = rough.join(level.ended, "mesh_id", "left_semi").select(*on, *_each(cols, lambda c: F.col("r_" + c).alias(c)))
    fixed = solve_direct(level.direct, plain, cols).select(*on, *_each(cols, lambda c: F.col(c).alias("z_" + c)))
    if at + 1 < len(levels):
        fixed = fixed.unionByName(v_cycle(levels, rough.join(level.ended, "mesh_id", "left_anti"), cols, at + 1))
    back = level.down.join(fixed.withColumnRenamed("v", "c"), ["mesh_id", "c"]).groupBy(*on).agg(*_each(cols, lambda c: F.sum(F.col("w") * F.col("z_" + c)).alias("y_" + c)))
    second = first.join(back, on).select(*on, "d", *["r_" + c for c in cols], *_each(cols, lambda c: (F.col("z_" + c) + F.col("y_" + c)).alias("z_" + c)))
    second = settle(second, "back")
    last = second.join(_times(level.columns, second, cols, "z_", "a_"), on)
    return last.select(*on, *_each(cols, lambda c: (F.col("z_" + c) + DAMP * F.try_divide(F.col("r_" + c) - F.col("a_" + c), F.col("d"))).alias("z_" + c)))


def multilevel_pcg(matrix: DataFrame, rhs: DataFrame, cols: list[str], tol: float, max_rounds: int, coarse: int | None = None) -> tuple[DataFrame, int]:
    """(mesh_id, v, *cols, residual, ok) and the rounds taken, for systems above the size of a direct solve.

    All systems and right-hand sides advance together; those whose residual |r| / |b| is at most `tol` leave. A
    system that is not positive definite shows it by a product that is not positive, and leaves with the
    residual it has and `ok` false. Each round is written, so a lost executor costs a round.
    """
    on = ["mesh_id", "v"]
    levels = hierarchy(matrix, coarse)
    parts = [pre + c for c in cols for pre in ("x_", "r_", "p_")]
    zero = lambda pre: _each(cols, lambda c: F.lit(0.0).alias(pre + c))
    size = settle(rhs.groupBy("mesh_id").agg(*_each(cols, lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))).alias("n_" + c))), "norms")
    st = settle(rhs.select(*on, *zero("x_"), *zero("p_"), *_each(cols, lambda c: F.col(c).alias("r_" + c))), "pcg")
    # one row a system: t = r.z of the last round, ok = no product failed yet
    dots = settle(size.select("mesh_id", *zero("t_"), F.lit(True).alias("ok")), "dots")
    done, rounds = None, 0
    while True:
        norm = st.groupBy("mesh_id").agg(*_each(cols, lambda c: F.sqrt(F.sum(F.col("r_" + c) * F.col("r_" + c))).alias("m_" + c))).join(size, "mesh_id")
        worst = F.greatest(*_each(cols, lambda c: F.when(F.col("n_" + c) > 0, F.col("m_" + c) / F.col("n_" + c)).otherwise(0.0)), F.lit(0.0))
        norm = norm.join(dots, "mesh_id").withColumn("residual", F.coalesce(F.nanvl(worst, F.lit(float("inf"))), F.lit(float("inf"))))
        norm = settle(norm.withColumn("going", (F.col("residual") > tol) & F.col("ok") & F.lit(rounds < max_rounds)).select("mesh_id", "residual", "ok", "going"), "norms")
        going, ending = norm.agg(F.count_if("going"), F.count_if(~F.col("going"))).first()
        if ending:
            out = settle(st.join(norm.where("not going"), "mesh_id").select(*on, *_each(cols, lambda c: F.col("x_" + c).alias(c)), "residual", "ok"), "solved")
            done = out if done is None else done.unionByName(out)
            st = settle(st.join(norm.where("going"), "mesh_id", "left_semi"), "pcg") if going else st
        if not going:
            return done, rounds
        z = v_cycle(levels, st.select(*on, *["r_" + c for c in cols]), cols)
        act = settle(st.join(z, on), "pcg")
        rz = act.groupBy("mesh_id").agg(*_each(cols, lambda c: F.sum(F.col("r_" + c) * F.col("z_" + c)).alias("u_" + c)))
        rz = settle(rz.join(dots.drop("ok"), "mesh_id"), "dots")
        turn = lambda c: F.coalesce(F.try_divide("u_" + c, "t_" + c), F.lit(0.0))
        way = act.join(rz, "mesh_id").select(*on, *[x for x in parts if x[0] != "p"], *_each(cols, lambda c: (F.col("z_" + c) + turn(c) * F.col("p_" + c)).alias("p_" + c)))
        met = settle(way.join(_times(levels[0].columns, way, cols, "p_", "q_"), on), "pcg")
        pq = met.groupBy("mesh_id").agg(*_each(cols, lambda c: F.sum(F.col("p_" + c) * F.col("q_" + c)).alias("g_" + c)))
        ok = F.lit(True)
        for c in cols:
            ok = ok & ((F.col("g_" + c) > 0) & (F.col("u_" + c) > 0) | (F.col("g_" + c) == 0))
        step = lambda c: F.coalesce(F.try_divide("u_" + c, "g_" + c), F.lit(0.0))
        dots = settle(rz.join(pq, "mesh_id").select("mesh_id", *_each(cols, lambda c: F.col("u_" + c).alias("t_" + c)),
                                                    *_each(cols, lambda c: step(c).alias("l_" + c)), F.coalesce(ok, F.lit(False)).alias("ok")), "dots")
        st = settle(met.join(dots, "mesh_id").select(
            *on, *_each(cols, lambda c: (F.col("x_" + c) + F.col("l_" + c) * F.col("p_" + c)).alias("x_" + c)),
            *_each(cols, lambda c: (F.col("r_" + c) - F.col("l_" + c) * F.col("q_" + c)).alias("r_" + c)), *["p_" + c for c in cols]), "pcg")
        dots = dots.drop(*["l_" + c for c in cols])
        rounds += 1


def solve_systems(matrix: DataFrame, rhs: DataFrame, cols: list[str], tol: float = 1e-11, max_rounds: int = 200, accept: float = 1e-8,
                  coarse: int | None = None, whole: bool = False) -> DataFrame:
    """x(mesh_id, v, *cols) with matrix x = rhs, for symmetric positive definite systems of any size.

    The residual |b - matrix x| / |b| of every answer is computed anew. A mesh whose matrix is singular or indefinite has
    NaN throughout, so callers can retry or fall back; with `whole`, for callers that can do neither, it is an error. A positive
    definite system that did not get below `accept` in its rounds is always an error: it has a solution, which this is not.
    """
    coarse, enough, nan = coarse or COARSE, max(accept, tol), F.lit(float("nan"))
    rhs, matrix = settle(rhs.select("mesh_id", "v", *cols), "rhs"), matrix.select("mesh_id", "row", "col", "val")
    large = settle(rhs.groupBy("mesh_id").agg(F.count("*").alias("n")).where(F.col("n") > coarse).select("mesh_id"), "large")
    more = None
    if large.limit(1).count():
        matrix = settle(matrix, "matrix")
        big = [df.join(large, "mesh_id", "left_semi") for df in (matrix, rhs)]
        more, _ = multilevel_pcg(*big, cols, tol, max_rounds, coarse)
        sound = F.col("ok") | (F.col("residual") <= enough)
        more = settle(more.select("mesh_id", "v", *_each(cols, lambda c: F.when(sound, F.col(c)).otherwise(nan).alias(c))), "solved")
        more = more.join(_missed(*big, more, cols), "mesh_id")
        matrix, rhs = (df.join(large, "mesh_id", "left_anti") for df in (matrix, rhs))
    out = solve_direct(matrix, rhs, cols)
    out = settle(out if more is None else out.unionByName(more), "solved")
    failed = out.where(F.col("bad") > enough)
    failed = (failed if whole else failed.where(F.col("bad") < float("inf"))).select("mesh_id", "bad").distinct()
    first = failed.limit(5).collect()
    if first:
        raise ArithmeticError(f"{failed.count()} linear systems are not solved: " + ", ".join(f"{r['mesh_id']} (residual {r['bad']:.1e})" for r in first))
    return out.select("mesh_id", "v", *_each(cols, lambda c: F.when(F.col("bad") <= enough, F.col(c)).otherwise(nan).alias(c)))


def _missed(matrix: DataFrame, rhs: DataFrame, x: DataFrame, cols: list[str]) -> DataFrame:
    """(mesh_id, bad): the worst |b - matrix x| / |b| of every mesh, infinite where it is unknown."""
    inf = F.lit(float("inf"))
    packed = matrix.groupBy("mesh_id", "col").agg(F.collect_list(F.struct("row", "val")).alias("entries"))
    ax = _times(packed, x, cols, "", "a_").withColumn("met", F.lit(True))
    # a product without a row is zero; an unknown one counts as infinitely far off, and is not left out of the sum
    miss = lambda c: F.coalesce(F.pow(F.col(c) - F.when(F.col("met"), F.col("a_" + c)).otherwise(0.0), 2), inf)
    far = rhs.join(ax, ["mesh_id", "v"], "left").groupBy("mesh_id").agg(*_each(cols, lambda c: F.sqrt(
        F.sum(miss(c)) / F.greatest(F.sum(F.col(c) * F.col(c)), F.lit(1e-300))).alias("m_" + c)))
    return far.select("mesh_id", F.greatest(*_each(cols, lambda c: F.coalesce(F.nanvl("m_" + c, inf), inf)), F.lit(0.0)).alias("bad"))
