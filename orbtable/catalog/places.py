"""Spatial joins: nearest neighbours, point location, self-intersection, grid interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.catalog import register
from orbtable.catalog.meshes import L, q
from orbtable.catalog.sqlkit import (
    PI, TAU, V, ADJ, HALF, _corners_cte, mesh_sql, rings_cte, rnd, sarea, scross, sdot, slen, snorm, ssub, values,
)
from orbtable.functions.vec import named, vec
from orbtable.operators import rank, spatial as spt, spectral as sp


def pts_cte(one: bool = False) -> str:
    cloud = "'all'" if one else "CAST(label AS VARCHAR)"
    return f"""pts AS (SELECT {cloud} AS cloud_id, vec_id AS p, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""


def knn_cte(k: int, one: bool = False) -> str:
    return "WITH " + pts_cte(one) + f""",
pr AS (SELECT a.cloud_id, a.p, b.p AS q, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z) AS d2 FROM pts a JOIN pts b ON a.cloud_id = b.cloud_id),
knn AS (SELECT cloud_id, p, CAST(k AS INTEGER) AS rank, q, d2 FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, p ORDER BY d2, q) AS k FROM pr) WHERE k <= {k})"""


@register("knn_join", knn_cte(25, True) + f" SELECT cloud_id, p, rank, q, {rnd('d2')} FROM knn")
def _(spark, sf):
    """All embeddings as one cloud, 25 neighbours."""
    return spt.knn_join(B.embedding_points(spark, sf, True), 25)


@register("knn_rank", knn_cte(8) + f" SELECT cloud_id, p, rank, q, {rnd('d2')} FROM knn")
def _(spark, sf):
    """One cloud per label, 8 neighbours."""
    return spt.knn_join(B.embedding_points(spark, sf), 8)


@register("knn_diff_rows", knn_cte(6) + """, s1 AS (SELECT cloud_id, p, list_sort(list(q)) AS s FROM knn WHERE rank <= 5 GROUP BY 1, 2),
s2 AS (SELECT cloud_id, p, list_sort(list(q)) AS s FROM knn WHERE rank <= CASE WHEN p % 9 = 0 THEN 6 ELSE 5 END GROUP BY 1, 2)
SELECT cloud_id, p FROM s1 JOIN s2 USING (cloud_id, p) WHERE s1.s <> s2.s""")
def _(spark, sf):
    """Two neighbour tables, one with an extra neighbour for every ninth point."""
    from orbtable.session import settle
    six = settle(spt.knn_join(B.embedding_points(spark, sf), 6), "knn")
    other = six.where(F.col("rank") <= F.when(F.col("p") % 9 == 0, 6).otherwise(5))
    return spt.knn_diff_rows(six.where("rank <= 5"), other)


def _warped_queries(m: B.Meshes) -> DataFrame:
    return m.warped.select("mesh_id", F.col("v").alias("q"), *[F.col("s" + k).alias(k) for k in "xyz"])


_NEAR = """, nd AS (SELECT a.mesh_id, a.v AS q, b.v, a.tx*b.sx+a.ty*b.sy+a.tz*b.sz AS dot,
  (a.tx-b.sx)*(a.tx-b.sx)+(a.ty-b.sy)*(a.ty-b.sy)+(a.tz-b.sz)*(a.tz-b.sz) AS d2 FROM verts a JOIN verts b ON a.mesh_id = b.mesh_id),
nv AS (SELECT mesh_id, q, v, dot FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id, q ORDER BY d2, v) AS k FROM nd) WHERE k = 1)"""


@q("nearest_vertex", _NEAR + f" SELECT mesh_id, q, v, {rnd('dot')} FROM nv", corners=False)
def _(spark, sf):
    """Every warped chart point against the exact chart of its mesh."""
    m = L(spark, sf)
    return spt.nearest_vertex(m.chart, _warped_queries(m))


def _locate_ctes() -> str:
    a, b, c, p = V("as"), V("bs"), V("cs"), V("q.t")
    vol = lambda u, v, w: sdot(u, scross(v, w))
    return _NEAR + "," + ADJ + f""",
w0 AS (SELECT fc.mesh_id, q.v AS q, f, a, b, c, {vol(a, b, c)} AS det, {vol(p, b, c)} AS n0, {vol(a, p, c)} AS n1, {vol(a, b, p)} AS n2
 FROM fc JOIN verts q ON q.mesh_id = fc.mesh_id),
w1 AS (SELECT mesh_id, q, f, a, b, c, n0/det AS u0, n1/det AS u1, n2/det AS u2 FROM w0 WHERE abs(det) >= 1e-14),
w2 AS (SELECT mesh_id, q, f, a, b, c, u0/(u0+u1+u2) AS w0, u1/(u0+u1+u2) AS w1, u2/(u0+u1+u2) AS w2 FROM w1 WHERE u0 >= -1e-12 AND u1 >= -1e-12 AND u2 >= -1e-12),
w3 AS (SELECT w2.*, CASE WHEN nv.v IN (a, b, c) THEN 0 WHEN EXISTS (SELECT 1 FROM adj WHERE adj.mesh_id = w2.mesh_id AND adj.v = nv.v AND adj.u IN (w2.a, w2.b, w2.c)) THEN 1 ELSE 2 END AS tier
 FROM w2 JOIN nv USING (mesh_id, q)),
w4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id, q ORDER BY tier, f) AS k FROM w3) WHERE k = 1),
located AS (SELECT mesh_id, q, f, a, b, c, w0, w1, w2, ['vertex', 'ring', 'sweep'][tier + 1] AS how FROM w4)"""


@q("locate_in_triangle", _locate_ctes() + f" SELECT mesh_id, q, f, {rnd('w0')}, {rnd('w1')}, {rnd('w2')}, how FROM located")
def _(spark, sf):
    m = L(spark, sf)
    return spt.locate(m.faces, m.chart, _warped_queries(m)).drop("a", "b", "c")


def _inside_ctes() -> str:
    """First containing face per query; on this valid chart every containing face gives the same value."""
    a, b, c, p = V("as"), V("bs"), V("cs"), V("q.t")
    vol = lambda u, v, w: sdot(u, scross(v, w))
    return f""", w0 AS (SELECT fc.mesh_id, q.v AS q, f, a, b, c, {vol(a, b, c)} AS det, {vol(p, b, c)} AS n0, {vol(a, p, c)} AS n1, {vol(a, b, p)} AS n2
 FROM fc JOIN verts q ON q.mesh_id = fc.mesh_id),
w2 AS MATERIALIZED (SELECT mesh_id, q, f, a, b, c, n0/(n0+n1+n2) AS w0, n1/(n0+n1+n2) AS w1, n2/(n0+n1+n2) AS w2 FROM w0
 WHERE abs(det) >= 1e-14 AND n0/det >= -1e-12 AND n1/det >= -1e-12 AND n2/det >= -1e-12),
located AS (SELECT * FROM w2 WHERE (mesh_id, q, f) IN (SELECT (mesh_id, q, min(f)) FROM w2 GROUP BY mesh_id, q))"""


@q("pl_interpolate", _inside_ctes() + f""" SELECT l.mesh_id, l.q, {', '.join(rnd(f'l.w0*p.{k}+l.w1*r.{k}+l.w2*s.{k}', k) for k in 'xyz')} FROM located l
JOIN verts p ON p.mesh_id = l.mesh_id AND p.v = l.a JOIN verts r ON r.mesh_id = l.mesh_id AND r.v = l.b JOIN verts s ON s.mesh_id = l.mesh_id AND s.v = l.c""")
def _(spark, sf):
    m = L(spark, sf)
    return spt.pl_interpolate(spt.locate(m.faces, m.chart, _warped_queries(m), label=False), m.vertices, ["x", "y", "z"])


# ---------------------------------------------------------------- self-intersection of the warped spheres


def _pairs_ctes() -> str:
    lo = ", ".join(f"least(at{k},bt{k},ct{k}) AS l{k}, greatest(at{k},bt{k},ct{k}) AS h{k}" for k in "xyz")
    a, b, c = V("at"), V("bt"), V("ct")
    u, v = ssub(b, a), ssub(c, a)
    n = scross(u, v)
    big = f"greatest({sdot(u, u)}, {sdot(v, v)}, {sdot(ssub(v, u), ssub(v, u))})"
    boxes = " AND ".join(f"p.l{k} <= r.h{k} + t.tol AND r.l{k} <= p.h{k} + t.tol" for k in "xyz")
    cols = ", ".join(f"p.{x} AS p{x}, r.{x} AS r{x}" for x in
                     [f"{k}t{d}" for k in "abc" for d in "xyz"] + ["nx", "ny", "nz", "nd"])
    return f""", tb0 AS (SELECT mesh_id, f, a, b, c, {', '.join(f'{k}t{d}' for k in 'abc' for d in 'xyz')}, {lo}, {', '.join(f'{x} AS n{k}' for x, k in zip(n, 'xyz'))}, {snorm(n)} AS nn, {big} AS big FROM fc),
tb1 AS (SELECT * EXCLUDE (nx, ny, nz), nx/nn AS nx, ny/nn AS ny, nz/nn AS nz FROM tb0 WHERE nn >= 1e-12*big AND nn > 0),
tb AS (SELECT *, -(nx*atx+ny*aty+nz*atz) AS nd FROM tb1),
tt AS (SELECT mesh_id, 1e-10*sqrt({'+'.join(f'(max(h{k})-min(l{k}))*(max(h{k})-min(l{k}))' for k in 'xyz')}) AS tol FROM tb0 GROUP BY 1),
bp AS (SELECT p.mesh_id, p.f AS pf, r.f AS rf, t.tol, (p.a IN (r.a, r.b, r.c) OR p.b IN (r.a, r.b, r.c) OR p.c IN (r.a, r.b, r.c)) AS adjacent, {cols}
 FROM tb p JOIN tb r ON p.mesh_id = r.mesh_id AND p.f < r.f JOIN tt t ON t.mesh_id = p.mesh_id WHERE {boxes})"""


@q("bbox_overlap", _pairs_ctes() + " SELECT mesh_id, count(*) AS pairs FROM bp GROUP BY 1")
def _(spark, sf):
    m = L(spark, sf)
    v = m.warped.select("mesh_id", "v", *[F.col("s" + k).alias(k) for k in "xyz"])
    boxed = spt._boxes(v, m.faces, 1e-10).where("nx IS NOT NULL")
    return spt.box_pairs(boxed).groupBy("mesh_id").agg(F.count("*").alias("pairs"))


@q("not_adjacent", _pairs_ctes() + " SELECT mesh_id, pf, rf AS qf FROM bp WHERE NOT adjacent")
def _(spark, sf):
    m = L(spark, sf)
    v = m.warped.select("mesh_id", "v", *[F.col("s" + k).alias(k) for k in "xyz"])
    boxed = spt._boxes(v, m.faces, 1e-10).where("nx IS NOT NULL")
    return spt.box_pairs(boxed).where(spt.not_adjacent()).select(
        "mesh_id", F.least("pf", "qf").alias("pf"), F.greatest("pf", "qf").alias("qf"))


def _moller() -> str:
    d = lambda n, s, k: f"({n}nx*{s}{k}tx+{n}ny*{s}{k}ty+{n}nz*{s}{k}tz+{n}nd)"
    e = ", ".join(f"{d('r', 'p', k)} AS e{i}" for i, k in enumerate("abc"))
    g_ = ", ".join(f"{d('p', 'r', k)} AS g{i}" for i, k in enumerate("abc"))
    lift = ", ".join(f"CASE WHEN abs({c}) < tol THEN tol ELSE {c} END AS {c}" for c in ("e0", "e1", "e2", "g0", "g1", "g2"))
    line = scross(V("pn"), V("rn"))
    along = ", ".join(f"CASE WHEN lx >= ly AND lx >= lz THEN {s}{k}tx WHEN ly > lx AND ly >= lz THEN {s}{k}ty ELSE {s}{k}tz END AS {s}{k}_" for s in "pr" for k in "abc")

    def iv(s, dd, o):
        end = lambda k, j: f"({s}{'abc'[j]}_ + ({s}{'abc'[k]}_-{s}{'abc'[j]}_)*{dd}{j}/({dd}{j}-{dd}{k}))"
        lone = f"CASE WHEN ({dd}0 > 0) = ({dd}1 > 0) THEN 2 WHEN ({dd}0 > 0) = ({dd}2 > 0) THEN 1 ELSE 0 END"
        one = lambda st: f"CASE {lone} WHEN 0 THEN {end(0, st % 3)} WHEN 1 THEN {end(1, (1 + st) % 3)} ELSE {end(2, (2 + st) % 3)} END"
        return f"{one(1)} AS {o}a, {one(2)} AS {o}b"

    side = lambda s: f"(({s}0 > 0 AND {s}1 > 0 AND {s}2 > 0) OR ({s}0 < 0 AND {s}1 < 0 AND {s}2 < 0))"
    return f""", k0 AS (SELECT *, {e}, {g_} FROM bp WHERE NOT adjacent),
k1 AS (SELECT * REPLACE ({lift}), (abs(e0) < tol AND abs(e1) < tol AND abs(e2) < tol) OR (abs(g0) < tol AND abs(g1) < tol AND abs(g2) < tol) AS flat FROM k0),
k2 AS (SELECT *, abs({line[0]}) AS lx, abs({line[1]}) AS ly, abs({line[2]}) AS lz FROM k1 WHERE NOT flat AND NOT {side('e')} AND NOT {side('g')}),
k3 AS (SELECT *, {along} FROM k2), k4 AS (SELECT *, {iv('p', 'e', 's')}, {iv('r', 'g', 'u')} FROM k3),
si AS (SELECT mesh_id, count(*) AS pairs FROM k4 WHERE greatest(sa, sb) >= least(ua, ub) - tol AND greatest(ua, ub) >= least(sa, sb) - tol GROUP BY 1)"""


@q("self_intersections", _pairs_ctes() + _moller() + " SELECT mesh_id, coalesce(pairs, 0) AS pairs FROM (SELECT DISTINCT mesh_id FROM faces) LEFT JOIN si USING (mesh_id)")
def _(spark, sf):
    m = L(spark, sf)
    v = m.warped.select("mesh_id", "v", *[F.col("s" + k).alias(k) for k in "xyz"])
    return spt.self_intersections(v, m.faces)


# ---------------------------------------------------------------- interpolation between grids

FINE = 16


def _gauss_rows(sizes) -> str:
    import numpy as np
    rows = []
    for n in sizes:
        x, _ = np.polynomial.legendre.leggauss(n)
        rows += [(n, i, float(np.arccos(c))) for i, c in enumerate(x[::-1])]
    return values("gth", "n, i, theta", rows)


def supplier_rings(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Coarse rings of every supplier's grid size and the fine rings they are read from."""
    cfg = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grid"), (2 + F.col("s_suppkey") % 11).cast("int").alias("nlat"))
    coarse = cfg.join(sp.rings_for(cfg), "nlat").select("grid", F.col("i").alias("r"), "theta")
    fine = cfg.select("grid", F.explode(F.sequence(F.lit(0), F.lit(FINE - 1))).alias("i")).join(
        sp.rings(spark, FINE).select("i", "theta"), "i")
    return coarse, fine


@register("ring_interp", "WITH " + _gauss_rows(list(range(2, 13)) + [FINE]) + f""",
co AS (SELECT s_suppkey AS grid, i AS r, theta FROM supplier JOIN gth ON n = 2 + s_suppkey % 11), fi AS (SELECT i, theta FROM gth WHERE n = {FINE}),
br AS (SELECT grid, r, theta, CAST(greatest(0, least({FINE - 2}, (SELECT max(i) FROM fi WHERE fi.theta <= co.theta))) AS INTEGER) AS a FROM co)
SELECT grid, r, coalesce(a, 0) AS a, coalesce(a, 0) + 1 AS b, {rnd('least(1.0, greatest(0.0, (br.theta - p.theta)/(s.theta - p.theta)))', 'w')}
FROM br JOIN fi p ON p.i = coalesce(a, 0) JOIN fi s ON s.i = coalesce(a, 0) + 1""")
def _(spark, sf):
    return spt.ring_brackets(*supplier_rings(spark, sf))


@register("meridian_interp", f"""SELECT grid, m, CAST(floor(m*32.0/nphi) AS INTEGER) % 32 AS c0, (CAST(floor(m*32.0/nphi) AS INTEGER) + 1) % 32 AS c1, {rnd('m*32.0/nphi - floor(m*32.0/nphi)', 'w')}
FROM (SELECT s_suppkey AS grid, CAST(5 + s_suppkey % 9 AS INTEGER) AS nphi, CAST(r.range AS INTEGER) AS m FROM supplier, range(13) r WHERE r.range < 5 + s_suppkey % 9)""")
def _(spark, sf):
    cfg = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grid"), (5 + F.col("s_suppkey") % 9).cast("int").alias("nphi"))
    return spt.meridian_brackets(cfg.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("nphi") - 1))), F.lit(32))
