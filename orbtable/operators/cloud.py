"""Point clouds: tangent frames, moving least squares, local triangulations, poles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbtable.functions import geometry as g
from orbtable.functions.vec import dot, named, norm, scale, sub, vec
from orbtable.operators.spatial import knn_join


def extreme_poles(points: DataFrame) -> DataFrame:
    """Points of largest and smallest z per cloud; the lowest id wins a tie."""
    return points.groupBy("cloud_id").agg(
        (-F.max(F.struct("z", (-F.col("p")).alias("n")))["n"]).alias("north"), F.min(F.struct("z", "p"))["p"].alias("south"))


def _offsets(points: DataFrame, knn: DataFrame) -> DataFrame:
    """Neighbours relative to their centre: (cloud_id, p, rank, q, x, y, z)."""
    at = lambda key, pre: points.select("cloud_id", F.col("p").alias(key), *[F.col(c).alias(pre + c) for c in "xyz"])
    j = knn.select("cloud_id", "p", "rank", "q").join(at("q", "n"), ["cloud_id", "q"]).join(at("p", "o"), ["cloud_id", "p"])
    return j.select("cloud_id", "p", "rank", "q", *named(sub(vec("n"), vec("o")), ""))


def covariance(points: DataFrame, knn: DataFrame) -> DataFrame:
    """Scatter of every neighbourhood about its mean, from six moment sums."""
    o = _offsets(points, knn)
    two = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    m = o.groupBy("cloud_id", "p").agg(
        F.count("*").alias("k"), *[F.sum(c).alias("s" + c) for c in "xyz"],
        *[F.sum(F.col(a) * F.col(b)).alias("m" + a + b) for a, b in two])
    return m.select("cloud_id", "p", *[(F.col("m" + a + b) - F.col("s" + a) * F.col("s" + b) / F.col("k")).alias("c" + a + b) for a, b in two])


def pca_frame(points: DataFrame, knn: DataFrame) -> DataFrame:
    """Eigenvalues l1 >= l2 >= l3 of every neighbourhood's scatter and its normal (nx, ny, nz).

    The moments are sums in Spark; only the 3x3 eigenproblem of a batch of rows is numpy. The
    normal's sign is fixed by its largest component.
    """
    @F.pandas_udf("struct<l1:double,l2:double,l3:double,nx:double,ny:double,nz:double>")
    def eigen(cxx: pd.Series, cxy: pd.Series, cxz: pd.Series, cyy: pd.Series, cyz: pd.Series, czz: pd.Series) -> pd.DataFrame:
        m = np.stack([cxx, cxy, cxz, cxy, cyy, cyz, cxz, cyz, czz], axis=1).reshape(-1, 3, 3)
        w, v = np.linalg.eigh(m)
        n = v[:, :, 0]
        big = np.take_along_axis(n, np.abs(n).argmax(axis=1)[:, None], axis=1)
        n = n * np.where(big < 0, -1.0, 1.0)
        return pd.DataFrame({"l1": w[:, 2], "l2": w[:, 1], "l3": w[:, 0], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]})

    c = covariance(points, knn)
    return c.select("cloud_id", "p", eigen("cxx", "cxy", "cxz", "cyy", "cyz", "czz").alias("e")).select("cloud_id", "p", "e.*")


def _packed(points: DataFrame, knn: DataFrame) -> DataFrame:
    """One row per point with its k neighbours in rank order: bounded by k."""
    o = _offsets(points, knn)
    return o.groupBy("cloud_id", "p").agg(F.array_sort(F.collect_list(F.struct("rank", "q", "x", "y", "z"))).alias("nb"))


def _tangent(xyz: np.ndarray) -> np.ndarray:
    """Rows in the frame of descending scatter."""
    d = xyz - xyz.mean(axis=0)
    w, v = np.linalg.eigh(d.T @ d)
    return xyz @ v[:, ::-1]


def _mls_row(xyz: np.ndarray) -> np.ndarray:
    """Weights of the Laplace-Beltrami row of one neighbourhood (first row is the centre)."""
    k = len(xyz)
    x, y, z = _tangent(xyz).T
    r2 = x * x + y * y
    w = np.exp(-np.sqrt(k) * r2 / r2.max()) / k
    w[0] = 1.0
    base = np.stack([np.ones(k), x, y, x * x, x * y, y * y])
    c = np.linalg.solve((base * w) @ base.T, base * w)
    h = c @ z  # slopes and curvatures of the height over the tangent plane
    p, q, r, s, t = h[1], h[2], 2 * h[3], h[4], 2 * h[5]
    # Laplace-Beltrami of a graph z = h(x, y): second-order part over 1 + |grad|^2 and the first-order correction
    g2 = 1 + p * p + q * q
    bend = 2 * p * q * s - r - q * q * r - t - p * p * t
    second = g2 * (2 * c[3] * (1 + q * q) - 2 * p * q * c[4] + 2 * c[5] * (1 + p * p))
    return second + bend * (p * c[1] + q * c[2])


def mls_laplacian(points: DataFrame, knn: DataFrame) -> DataFrame:
    """triplets(cloud_id, row, col, val): Laplace-Beltrami by a weighted quadratic fit in the tangent plane."""
    @F.pandas_udf("array<double>")
    def rows(xs: pd.Series, ys: pd.Series, zs: pd.Series) -> pd.Series:
        out = []
        for t in zip(xs, ys, zs):
            try:
                out.append(_mls_row(np.stack(t, axis=1)).tolist())
            except np.linalg.LinAlgError:
                out.append([float("nan")] * len(t[0]))
        return pd.Series(out)

    p = _packed(points, knn).withColumn("val", rows("nb.x", "nb.y", "nb.z"))
    return p.select("cloud_id", F.col("p").alias("row"), F.inline(F.arrays_zip(F.col("nb.q").alias("col"), F.col("val").alias("val"))))


def _ring_triangles(xy: np.ndarray) -> list[tuple[int, int]]:
    """Neighbour pairs (i, j) that form Delaunay triangles with point 0.

    Such a triangle has an empty circumcircle, so by inversion about point 0 it is an edge of
    the convex hull of the inverted neighbours: one small hull instead of a triangulation.
    """
    d = xy[1:] - xy[0]
    n2 = (d * d).sum(axis=1)
    ok = np.flatnonzero(n2 > 0)
    if len(ok) < 2:
        return []
    inv = d[ok] / n2[ok, None]
    pts = np.vstack([inv, np.zeros(2)])  # the centre stands for infinity's image
    order = sorted(range(len(pts)), key=lambda i: (pts[i, 0], pts[i, 1]))

    def chain(seq):
        out: list[int] = []
        for i in seq:
            while len(out) >= 2:
                u, v = pts[out[-1]] - pts[out[-2]], pts[i] - pts[out[-2]]
                if u[0] * v[1] - u[1] * v[0] <= 0:
                    out.pop()
                else:
                    break
            out.append(i)
        return out

    hull = chain(order)[:-1] + chain(order[::-1])[:-1]
    centre = len(pts) - 1
    pairs = [(hull[i], hull[(i + 1) % len(hull)]) for i in range(len(hull))]
    return [(int(ok[a]) + 1, int(ok[b]) + 1) for a, b in pairs if centre not in (a, b)]


def local_delaunay_ring(points: DataFrame, knn: DataFrame) -> DataFrame:
    """rings_local(cloud_id, p, a, b, c): Delaunay triangles at p among its projected neighbours; a = p."""
    @F.pandas_udf("array<struct<i:int,j:int>>")
    def rings(xs: pd.Series, ys: pd.Series, zs: pd.Series) -> pd.Series:
        return pd.Series([
            [{"i": i, "j": j} for i, j in _ring_triangles(_tangent(np.stack(t, axis=1))[:, :2])] for t in zip(xs, ys, zs)])

    p = _packed(points, knn).withColumn("tri", rings("nb.x", "nb.y", "nb.z"))
    q = F.col("nb.q")
    t = p.select("cloud_id", "p", "nb", F.inline("tri"))
    return t.select("cloud_id", "p", q[0].alias("a"), q[F.col("i")].alias("b"), q[F.col("j")].alias("c"))


def ring_minus_self(rings: DataFrame) -> DataFrame:
    """Vertices of every local ring without its centre."""
    pairs = rings.select("cloud_id", "p", F.explode(F.array("a", "b", "c")).alias("u")).where("u <> p")
    # the two directions of a pair share a row of the aggregation, with a bit each
    way = pairs.groupBy("cloud_id", F.least("p", "u").alias("lo"), F.greatest("p", "u").alias("hi")).agg(
        F.bit_or(F.when(F.col("p") < F.col("u"), 1).otherwise(2)).alias("way"))
    up, down = (F.array(F.struct(F.col(a).alias("p"), F.col(b).alias("u"))) for a, b in (("lo", "hi"), ("hi", "lo")))
    return way.select("cloud_id", F.inline(F.when(F.col("way") == 1, up).when(F.col("way") == 2, down).otherwise(F.concat(up, down))))


def induced_mesh(rings: DataFrame) -> DataFrame:
    """Triangles all three corners agree on: (cloud_id, f-less canonical a < b < c)."""
    tri = rings.select("cloud_id", "p", F.array_sort(F.array("a", "b", "c")).alias("t"))
    votes = tri.groupBy("cloud_id", "t").agg(F.count_distinct("p").alias("n")).where("n = 3")
    return votes.select("cloud_id", *[F.col("t")[i].alias(c) for i, c in enumerate("abc")])


def mesh_share(rings: DataFrame, points: DataFrame) -> DataFrame:
    """Induced faces per cloud against the 2n - 4 of a closed triangulation."""
    n = points.groupBy("cloud_id").agg(F.count("*").alias("n"))
    f = induced_mesh(rings).groupBy("cloud_id").agg(F.count("*").alias("nf"))
    return n.join(f, "cloud_id", "left").select(
        "cloud_id", "n", F.coalesce("nf", F.lit(0).cast("bigint")).alias("nf"),
        (F.coalesce("nf", F.lit(0)) / F.greatest(2 * F.col("n") - 4, F.lit(1))).alias("share"))


def pole_balance(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Rescale the south-pole plane of a cloud on the sphere so that both poles' rings have equal mean reach."""
    poles = extreme_poles(points)
    ring = ring_minus_self(rings)
    at = lambda key, pre: points.select("cloud_id", F.col("p").alias(key), *[F.col(c).alias(pre + c) for c in "xyz"])

    def reach(pole: str, sign: int) -> DataFrame:
        r = poles.select("cloud_id", F.col(pole).alias("p")).join(ring, ["cloud_id", "p"]).join(at("p", "o"), ["cloud_id", "p"]).join(at("u", "n"), ["cloud_id", "u"])
        d0, d1 = 1 + sign * F.col("oz"), 1 + sign * F.col("nz")
        du, dw = F.col("nx") / d1 - F.col("ox") / d0, F.col("ny") / d1 - F.col("oy") / d0
        return r.groupBy("cloud_id").agg(F.avg(F.sqrt(du * du + dw * dw)).alias(pole + "_reach"))

    k = reach("north", -1).join(reach("south", 1), "cloud_id").select(
        "cloud_id", (F.sqrt(F.col("north_reach") * F.col("south_reach")) / F.col("south_reach")).alias("k"))
    u, w = g.stereo_south(vec(""))
    return points.join(k, "cloud_id").select("cloud_id", "p", (u * F.col("k")).alias("u"), (w * F.col("k")).alias("w")).select(
        "cloud_id", "p", *named(g.unstereo(F.col("u"), F.col("w"), True), ""))
