"""Triangle-triangle overlap as staged column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbtable.functions.vec import cross, dot, fence, norm, sub, vec

# fixed value: a triangle whose doubled area is below this share of its longest squared edge has no plane
SLIVER = 1e-12


def with_plane(df: DataFrame, keep: list[str]) -> DataFrame:
    """Add the unit normal nx, ny, nz and offset nd of corners ax..cz (NULL for a collapsed triangle)."""
    a, b, c = vec("a"), vec("b"), vec("c")
    u, v = sub(b, a), sub(c, a)
    w = sub(v, u)
    n = cross(u, v)
    size = F.greatest(dot(u, u), dot(v, v), dot(w, w))
    df = df.select(*keep, *[x.alias("n" + k) for x, k in zip(n, "xyz")], norm(n).alias("_n"), size.alias("_s"))
    live = F.when((F.col("_n") >= SLIVER * F.col("_s")) & (F.col("_n") > 0), F.col("_n"))
    df = df.select(*keep, *[(F.col("n" + k) / live).alias("n" + k) for k in "xyz"])
    return df.withColumn("nd", -dot(vec("n"), vec("a")))


def _crossing_interval(p: list[str], d: list[str], out: str) -> list[Column]:
    """Ends of a triangle's stretch on the line where the planes meet.

    p are the corner coordinates along that line, d their signed distances to the other
    plane. The corner alone on its side is joined to the two others.
    """
    up = [F.col(x) > 0 for x in d]
    lone = F.when(up[0] == up[1], 2).when(up[0] == up[2], 1).otherwise(0)

    def end(k, o):
        num = (F.col(p[k]) - F.col(p[o])) * F.col(d[o])
        gap = F.col(d[o]) - F.col(d[k])
        return F.col(p[o]) + num / F.when(gap != 0, gap)

    ends = []
    for step in (1, 2):
        ends.append(
            F.when(lone == 0, end(0, step % 3)).when(lone == 1, end(1, (1 + step) % 3)).otherwise(end(2, (2 + step) % 3)))
    return [F.least(*ends).alias(out + "0"), F.greatest(*ends).alias(out + "1")]


def overlapping(pairs: DataFrame, keep: list[str], tol: str = "tol") -> DataFrame:
    """Adds `hit`: whether triangles P (p-prefixed columns) and Q (q-prefixed) cross each other.

    Planes use unit normals, so `tol` is a distance. Coplanar overlap and a corner exactly on
    the other plane are not crossings.
    """
    t = F.col(tol)
    carry = [c for s in "pq" for k in "abc" for c in (f"{s}{k}x", f"{s}{k}y", f"{s}{k}z")]
    normals = [f"{s}n{k}" for s in "pq" for k in "xyz"]
    to_q = [dot(vec("qn"), vec("p" + k)) + F.col("qnd") for k in "abc"]
    to_p = [dot(vec("pn"), vec("q" + k)) + F.col("pnd") for k in "abc"]
    df = pairs.select(*keep, tol, *carry, *normals,
                      *[c.alias(f"e{i}") for i, c in enumerate(to_q)], *[c.alias(f"g{i}") for i, c in enumerate(to_p)])
    names = [f"{s}{i}" for s in "eg" for i in range(3)]
    flat = lambda s: (F.abs(f"{s}0") < t) & (F.abs(f"{s}1") < t) & (F.abs(f"{s}2") < t)
    lifted = [F.when(F.abs(c) < t, t).otherwise(F.col(c)).alias(c) for c in names]
    df = df.select(*keep, tol, *carry, *normals, (flat("e") | flat("g")).alias("coplanar"), *lifted)
    one_side = lambda s: (
        ((F.col(s + "0") > 0) & (F.col(s + "1") > 0) & (F.col(s + "2") > 0))
        | ((F.col(s + "0") < 0) & (F.col(s + "1") < 0) & (F.col(s + "2") < 0)))
    line = cross(vec("pn"), vec("qn"))
    df = df.select("*", (~F.col("coplanar") & ~one_side("e") & ~one_side("g")).alias("apart_no"),
                   *[F.abs(x).alias("l" + k) for x, k in zip(line, "xyz")])
    use_x = (F.col("lx") >= F.col("ly")) & (F.col("lx") >= F.col("lz"))
    use_y = (F.col("ly") > F.col("lx")) & (F.col("ly") >= F.col("lz"))
    along = lambda s, k: F.when(use_x, F.col(f"{s}{k}x")).when(use_y, F.col(f"{s}{k}y")).otherwise(F.col(f"{s}{k}z"))
    df = df.select(*keep, tol, "apart_no", *names, *[along(s, k).alias(f"{s}{k}_") for s in "pq" for k in "abc"])
    df = df.select(*keep, tol, "apart_no",
                   *_crossing_interval(["pa_", "pb_", "pc_"], ["e0", "e1", "e2"], "s"),
                   *_crossing_interval(["qa_", "qb_", "qc_"], ["g0", "g1", "g2"], "r"))
    meet = (F.col("s1") >= F.col("r0") - t) & (F.col("r1") >= F.col("s0") - t)
    return fence(df, keep, F.coalesce(F.col("apart_no") & meet, F.lit(False)).alias("hit"))
