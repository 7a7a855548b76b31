"""Queries on the supplier meshes: connectivity, face measures, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.catalog import register
from orbtable.catalog.sqlkit import (
    ADJ, CORN, HALF, PI, TAU, V, mesh_sql, rnd, sadd, sangle, sarea, scross, sdot, slen, snorm, sreg, sscale, ssub, svol,
)
from orbtable.functions import geometry as g
from orbtable.functions.vec import named, norm, unit_columns, vec
from orbtable.operators import faces as fo, matrices as mx, mesh as mo, rank

NV = B.L_NLAT * B.L_NPHI


def L(spark, sf) -> B.Meshes:
    return B.lineitem_meshes(spark, sf)


def exact_frame(spark, sf) -> DataFrame:
    m = L(spark, sf)
    return mo.charted_corners(m.faces, m.vertices, m.chart)


def warped_frame(spark, sf) -> DataFrame:
    m = L(spark, sf)
    return mo.charted_corners(m.faces, m.vertices, m.warped)


def q(name, tail, corners=True, digits=6, **kw):
    return register(name, mesh_sql(tail, corners, **kw), digits=digits)


def rs(*cols):
    return ", ".join(rnd(c) for c in cols)


# ---------------------------------------------------------------- connectivity


@q("face_corners", f" SELECT mesh_id, f, a, b, c, {rs('ax','ay','az','bx','by','bz','cx','cy','cz')} FROM fc")
def _(spark, sf):
    m = L(spark, sf)
    return mo.face_corners(m.faces, m.vertices, ["x", "y", "z"])


@q("edges", "," + HALF + " SELECT mesh_id, lo, hi, n, opp1, opp2 FROM edges", corners=False)
def _(spark, sf):
    return mo.edges(L(spark, sf).faces).drop("ord", "f1", "f2")


@q("face_pairs", "," + HALF + " SELECT mesh_id, lo, hi, f1, f2 FROM edges WHERE n = 2", corners=False)
def _(spark, sf):
    return mo.face_pairs(L(spark, sf).faces)


@q("adjacency", "," + ADJ + " SELECT * FROM adj", corners=False)
def _(spark, sf):
    return mo.adjacency(L(spark, sf).faces)


@q("directed_to_undirected", "," + HALF + " SELECT DISTINCT mesh_id, v, u FROM (SELECT mesh_id, u AS v, w AS u FROM he UNION ALL SELECT mesh_id, w, u FROM he)", corners=False)
def _(spark, sf):
    return mo.undirected(mo.half_edges(L(spark, sf).faces), "u", "w")


@q("vertex_faces", " SELECT mesh_id, v, f FROM " + CORN.format(t="faces"), corners=False)
def _(spark, sf):
    return mo.vertex_faces(L(spark, sf).faces)


_OPEN = ", open AS (SELECT * FROM faces WHERE NOT (f < 3 AND CAST(substr(mesh_id, 2) AS BIGINT) % 5 = 0))"


def _open_faces(faces: DataFrame) -> DataFrame:
    """Every fifth mesh loses its first faces and is no longer closed."""
    return faces.where(~((F.col("f") < 3) & (F.substring("mesh_id", 2, 20).cast("bigint") % 5 == 0)))


@q("boundary_edges", _OPEN + "," + HALF.replace("FROM faces", "FROM open") + " SELECT mesh_id, lo, hi FROM edges WHERE n % 2 = 1", corners=False)
def _(spark, sf):
    return mo.boundary_edges(_open_faces(L(spark, sf).faces))


_CHI = """SELECT v.mesh_id, nv, ne, nf, nv - ne + nf AS chi FROM (SELECT mesh_id, count(*) AS nv FROM verts GROUP BY 1) v
JOIN (SELECT mesh_id, count(*) AS ne FROM edges GROUP BY 1) e USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS nf FROM {t} GROUP BY 1) f USING (mesh_id)"""


@q("euler_char", _OPEN + "," + HALF.replace("FROM faces", "FROM open") + " " + _CHI.format(t="open"), corners=False)
def _(spark, sf):
    m = L(spark, sf)
    return mo.euler_char(m.vertices, _open_faces(m.faces))


@q("genus0_gate", _OPEN + "," + HALF.replace("FROM faces", "FROM open") + ", chi AS (" + _CHI.format(t="open")
   + f") SELECT mesh_id, v, {rs('x', 'y', 'z')} FROM verts WHERE mesh_id IN (SELECT mesh_id FROM chi WHERE chi = 2)", corners=False)
def _(spark, sf):
    m = L(spark, sf)
    return m.vertices.join(mo.genus0_gate(m.vertices, _open_faces(m.faces)), "mesh_id", "leftsemi")


@q("weld", f""", fr AS (SELECT mesh_id, f, {', '.join(f'round({c}, 3) + 0.0 AS {c}' for k in 'abc' for c in V(k))} FROM fc),
cr AS (SELECT mesh_id, f, k, x, y, z, 3*f+k AS ord FROM (
  SELECT mesh_id, f, 0 AS k, ax AS x, ay AS y, az AS z FROM fr UNION ALL SELECT mesh_id, f, 1, bx, by, bz FROM fr UNION ALL SELECT mesh_id, f, 2, cx, cy, cz FROM fr))
SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY ord) - 1 AS v, x, y, z
FROM (SELECT mesh_id, x, y, z, min(ord) AS ord FROM cr GROUP BY 1, 2, 3, 4)""")
def _(spark, sf):
    """Corner soup on a millimetre lattice, so that nearby corners coincide."""
    m = L(spark, sf)
    v = m.vertices.select("mesh_id", "v", *[(F.round(k, 3) + F.lit(0.0)).alias(k) for k in "xyz"])
    fr = mo.face_corners(m.faces, v, ["x", "y", "z"])
    corner = lambda i, k: F.struct(F.lit(i).alias("k"), *[F.col(k + c).alias(c) for c in "xyz"])
    soup = fr.select("mesh_id", "f", F.inline(F.array(corner(0, "a"), corner(1, "b"), corner(2, "c"))))
    return mo.weld(soup)[0]


_USED = """, sub AS (SELECT * FROM faces WHERE f % 3 = 0),
use AS (SELECT mesh_id, v, min(3*f + k) AS ord FROM (SELECT mesh_id, f, 0 AS k, a AS v FROM sub UNION ALL SELECT mesh_id, f, 1, b FROM sub UNION ALL SELECT mesh_id, f, 2, c FROM sub) GROUP BY 1, 2),
fu AS (SELECT mesh_id, v, row_number() OVER (PARTITION BY mesh_id ORDER BY ord) - 1 AS id FROM use)"""


@q("compact_points", _USED + f" SELECT fu.mesh_id, id AS v, {rs('x', 'y', 'z')} FROM fu JOIN verts USING (mesh_id, v)", corners=False)
def _(spark, sf):
    m = L(spark, sf)
    return mo.compact_points(m.vertices, m.faces.where("f % 3 = 0"))[0]


@q("dense_renumber", _USED + """ SELECT s.mesh_id, s.f, ka.id AS a, kb.id AS b, kc.id AS c FROM sub s
 JOIN fu ka ON ka.mesh_id = s.mesh_id AND ka.v = s.a JOIN fu kb ON kb.mesh_id = s.mesh_id AND kb.v = s.b JOIN fu kc ON kc.mesh_id = s.mesh_id AND kc.v = s.c""", corners=False)
def _(spark, sf):
    m = L(spark, sf)
    return mo.compact_points(m.vertices, m.faces.where("f % 3 = 0"))[1]


# ---------------------------------------------------------------- whole-mesh measures

_BOX = """, box AS (SELECT mesh_id, min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy, min(z) AS loz, max(z) AS hiz FROM verts GROUP BY 1),
bd AS (SELECT *, sqrt((hix-lox)*(hix-lox)+(hiy-loy)*(hiy-loy)+(hiz-loz)*(hiz-loz)) AS diag FROM box)"""


@q("bbox_diagonal", _BOX + f" SELECT mesh_id, {rnd('diag')} FROM bd", corners=False)
def _(spark, sf):
    return mo.bbox_diagonal(L(spark, sf).vertices)


@q("normalize_bbox", _BOX + f" SELECT mesh_id, v, {rnd('(x-(lox+hix)/2)/diag', 'x')}, {rnd('(y-(loy+hiy)/2)/diag', 'y')}, {rnd('(z-(loz+hiz)/2)/diag', 'z')} FROM verts JOIN bd USING (mesh_id)", corners=False)
def _(spark, sf):
    return mo.normalize_bbox(L(spark, sf).vertices)


@q("strip_to_cloud", f" SELECT mesh_id AS cloud_id, v AS p, {rs('x', 'y', 'z')} FROM verts", corners=False)
def _(spark, sf):
    return mo.strip_to_cloud(L(spark, sf).vertices)


@q("radius_field", f" SELECT mesh_id, v, {rnd('sqrt(x*x+y*y+z*z)', 'r')} FROM verts", corners=False)
def _(spark, sf):
    return L(spark, sf).vertices.select("mesh_id", "v", norm(vec("")).alias("r"))


@q("rms_radius", f" SELECT mesh_id, {rnd('sqrt(avg(x*x+y*y+z*z))', 'r')} FROM verts GROUP BY 1", corners=False)
def _(spark, sf):
    return mo.rms_radius(L(spark, sf).vertices)


@q("face_areas", f" SELECT mesh_id, f, {rnd(sarea(), 'area')} FROM fc")
def _(spark, sf):
    return fo.face_areas(exact_frame(spark, sf))


@q("surface_area", f" SELECT mesh_id, count(*) AS nf, {rnd(f'sum({sarea()})', 'area')} FROM fc GROUP BY 1")
def _(spark, sf):
    return fo.surface_area(exact_frame(spark, sf))


@q("collapsed_faces", f" SELECT mesh_id, count(*) FILTER (WHERE {sarea('s')} > 0 AND {sarea('t')} < 0.3*{sarea('s')}) AS collapsed, count(*) AS nf FROM fc GROUP BY 1")
def _(spark, sf):
    """Warped chart against the exact one; a share of 0.3 so that every mesh has some."""
    return fo.collapsed_faces(fo.face_areas(warped_frame(spark, sf), True), fo.face_areas(exact_frame(spark, sf), True), 0.3)


_FOLD = f"""
vs AS (SELECT mesh_id, f, a, b, c, sign({svol('t')}) AS sg FROM fc),
mj AS (SELECT mesh_id, CASE WHEN 2*count(*) FILTER (WHERE sg > 0) >= count(*) THEN 1 ELSE -1 END AS maj FROM vs GROUP BY 1),
bad AS (SELECT vs.* FROM vs JOIN mj USING (mesh_id) WHERE sg <> maj)"""


@q("fold_count", "," + _FOLD + " SELECT mesh_id, count(*) FILTER (WHERE sg <> maj) AS folds FROM vs JOIN mj USING (mesh_id) GROUP BY 1")
def _(spark, sf):
    return fo.fold_count(warped_frame(spark, sf))


@q("fold_grow", "," + _FOLD + "," + ADJ + """, touch AS (SELECT DISTINCT mesh_id, v FROM """ + CORN.format(t="bad") + """)
SELECT DISTINCT mesh_id, v FROM (SELECT * FROM touch UNION ALL SELECT adj.mesh_id, adj.u FROM adj JOIN touch ON touch.mesh_id = adj.mesh_id AND touch.v = adj.v)""")
def _(spark, sf):
    m = L(spark, sf)
    from orbtable.operators.iterate import fold_grow
    return fold_grow(fo.folded_faces(warped_frame(spark, sf)), mo.adjacency(m.faces))


_LAM = f"lam AS (SELECT mesh_id, f, a, b, c, {sarea('t')}/greatest({sarea()}, 1e-300) AS lam FROM fc)"
_ROUGH = "," + HALF + f""", {_LAM},
jumps AS (SELECT e.mesh_id, abs(ln(p.lam) - ln(q.lam)) AS jump FROM edges e JOIN lam p ON p.mesh_id = e.mesh_id AND p.f = e.f1
 JOIN lam q ON q.mesh_id = e.mesh_id AND q.f = e.f2 WHERE e.n = 2),
jr AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY jump) - 1 AS k, count(*) OVER (PARTITION BY mesh_id) AS n FROM jumps),
rough AS (SELECT mesh_id, avg(jump) AS mean, max(CASE WHEN k = floor(0.99*(n-1)) THEN jump END) AS p99 FROM jr GROUP BY 1)"""


@q("lambda_stats", f", {_LAM} SELECT mesh_id, {rnd('stddev_pop(lam)/avg(lam)', 'spread')}, {rnd('max(lam)/min(lam)', 'ratio', 4)} FROM lam GROUP BY 1", digits=None)
def _(spark, sf):
    s = fo.lambda_stats(warped_frame(spark, sf))
    return s.select("mesh_id", (F.round("spread", 6) + 0.0).alias("spread"), (F.round("ratio", 4) + 0.0).alias("ratio"))


@q("chart_roughness", _ROUGH + f" SELECT mesh_id, {rs('mean', 'p99')} FROM rough")
def _(spark, sf):
    return fo.chart_roughness(warped_frame(spark, sf))


@q("chart_report", _ROUGH + "," + _FOLD + f""" SELECT r.mesh_id, 'given' AS type, {rnd('r.mean', 'rough_mean')}, {rnd('r.p99', 'rough_p99')},
 {rnd('s.spread', 'spread')}, {rnd('s.ratio', 'ratio', 4)}, fd.folds, s.ratio > 30 AS crowded
FROM rough r JOIN (SELECT mesh_id, stddev_pop(lam)/avg(lam) AS spread, max(lam)/min(lam) AS ratio FROM lam GROUP BY 1) s USING (mesh_id)
JOIN (SELECT mesh_id, count(*) FILTER (WHERE sg <> maj) AS folds FROM vs JOIN mj USING (mesh_id) GROUP BY 1) fd USING (mesh_id)""", digits=None)
def _(spark, sf):
    """Crowding is set at a ratio of 30, which some of these meshes exceed."""
    r = fo.chart_report(warped_frame(spark, sf), crowded_at=30.0)
    six = ["rough_mean", "rough_p99", "spread"]
    return r.select("mesh_id", "type", *[(F.round(c, 6) + 0.0).alias(c) for c in six], (F.round("ratio", 4) + 0.0).alias("ratio"), "folds", "crowded")


_ERR = f"""err AS (SELECT mesh_id, f, greatest({', '.join(f'abs({sangle(*t)}-{sangle(*t, "t")})' for t in ('abc', 'bca', 'cab'))}) AS err,
 least({', '.join(sangle(*t, 't') for t in ('abc', 'bca', 'cab'))}) AS min_angle FROM fc)"""


@q("sliver_filter", f", {_ERR} SELECT mesh_id, f, {rnd('min_angle')} FROM err WHERE min_angle < 0.05")
def _(spark, sf):
    return fo.sliver_filter(warped_frame(spark, sf))


@q("angle_distortion", f""", {_ERR}, er AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY err) - 1 AS k, count(*) OVER (PARTITION BY mesh_id) AS n FROM err)
SELECT mesh_id, {', '.join(rnd(f'180/{PI}*max(CASE WHEN k = floor({p}*(n-1)) THEN err END)', c) for c, p in (('median', 0.5), ('p90', 0.9), ('p99', 0.99), ('max', 1.0)))},
 count(*) FILTER (WHERE min_angle < 0.05) AS slivers, n AS nf FROM er GROUP BY mesh_id, n""")
def _(spark, sf):
    return fo.angle_distortion(warped_frame(spark, sf))


def _dens(pre: str, out: str) -> str:
    return f"""{out}_r AS (SELECT mesh_id, v, sum(area) AS av, count(*) AS val FROM (SELECT mesh_id, {sarea(pre)} AS area, unnest([a, b, c]) AS v FROM fc) GROUP BY 1, 2),
{out}_t AS (SELECT mesh_id, sum({sarea(pre)}) AS tot FROM fc GROUP BY 1),
{out} AS (SELECT mesh_id, v, (val+1)/(av/tot) AS d FROM {out}_r JOIN {out}_t USING (mesh_id))"""


@q("vertex_density", f", {_dens('t', 'dn')} SELECT mesh_id, v, {rnd('d')} FROM dn")
def _(spark, sf):
    return fo.vertex_density(L(spark, sf).vertices, warped_frame(spark, sf))


@q("density_ratio_spread", f""", {_dens('t', 'd1')}, {_dens('s', 'd2')},
rr AS (SELECT d1.mesh_id, d1.d/d2.d AS r FROM d1 JOIN d2 USING (mesh_id, v)),
rk AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY mesh_id) AS n FROM rr)
SELECT mesh_id, {rnd('max(CASE WHEN k = floor(0.99*(n-1)) THEN r END)/max(CASE WHEN k = floor(0.01*(n-1)) THEN r END)', 'spread')} FROM rk GROUP BY 1""")
def _(spark, sf):
    """p99 / p1 of the ratio of two vertex densities (warped chart against exact chart)."""
    m = L(spark, sf)
    d1 = fo.vertex_density(m.vertices, warped_frame(spark, sf))
    d2 = fo.vertex_density(m.vertices, exact_frame(spark, sf)).withColumnRenamed("d", "e")
    ratio = d1.join(d2, ["mesh_id", "v"]).select("mesh_id", (F.col("d") / F.col("e")).alias("r"))
    o = rank.order_statistics(ratio, ["mesh_id"], "r", {"hi": ("floor", 0.99), "lo": ("floor", 0.01)})
    return o.select("mesh_id", (F.col("hi") / F.col("lo")).alias("spread"))


_F2V = f"""fv AS (SELECT mesh_id, v, sum(w*rho)/sum(w) AS rho FROM (
 SELECT mesh_id, {sarea('t')} AS w, {sarea()}/greatest({sarea('t')}, 1e-300) AS rho, unnest([a, b, c]) AS v FROM fc) GROUP BY 1, 2)"""


@q("face_to_vertex", f" SELECT mesh_id, v, {rnd('sum(area*reg)/sum(area)', 'reg')} FROM (SELECT mesh_id, {sarea()} AS area, {sreg()} AS reg, unnest([a, b, c]) AS v FROM fc) GROUP BY 1, 2")
def _(spark, sf):
    fr = exact_frame(spark, sf)
    p = (vec("a"), vec("b"), vec("c"))
    return fo.face_to_vertex(fr, {"reg": g.irregularity(*p)}, g.tri_area(*p))


@q("population_density", f", {_F2V} SELECT mesh_id, {rnd('stddev_pop(rho)/avg(rho)', 'spread')} FROM fv GROUP BY 1")
def _(spark, sf):
    return fo.density_spread(fo.vertex_population_density(warped_frame(spark, sf)))


def _grad_sql() -> str:
    a, b, c = V("at"), V("bt"), V("ct")
    n = scross(ssub(c, b), ssub(a, c))
    t = sadd(sscale(ssub(c, b), "ar"), sscale(ssub(a, c), "br"), sscale(ssub(b, a), "cr"))
    nn = tuple(f"n{k}" for k in "xyz")
    tt = tuple(f"t{k}" for k in "xyz")
    cr = scross(nn, tt)
    return f""", {_F2V},
fg0 AS (SELECT fc.*, p.rho AS ar, q.rho AS br, r.rho AS cr FROM fc JOIN fv p ON p.mesh_id = fc.mesh_id AND p.v = fc.a
 JOIN fv q ON q.mesh_id = fc.mesh_id AND q.v = fc.b JOIN fv r ON r.mesh_id = fc.mesh_id AND r.v = fc.c),
fg1 AS (SELECT mesh_id, a, b, c, {sarea('t')} AS w, {', '.join(f'{x} AS n{k}' for x, k in zip(n, 'xyz'))}, {', '.join(f'{x} AS t{k}' for x, k in zip(t, 'xyz'))} FROM fg0),
fg2 AS (SELECT mesh_id, w, {', '.join(f'{x}/{sdot(nn, nn)} AS g{k}' for x, k in zip(cr, 'xyz'))}, unnest([a, b, c]) AS v FROM fg1),
fg3 AS (SELECT mesh_id, v, {', '.join(f'sum(w*g{k})/sum(w) AS g{k}' for k in 'xyz')} FROM fg2 GROUP BY 1, 2),
fg4 AS (SELECT mesh_id, v, tx, ty, tz, {', '.join(f'-g{k}/rho AS d{k}' for k in 'xyz')} FROM fg3 JOIN fv USING (mesh_id, v) JOIN verts USING (mesh_id, v))
SELECT mesh_id, v, {', '.join(rnd(f'd{k} - (dx*tx+dy*ty+dz*tz)*t{k}', f'd{k}', 4) for k in 'xyz')} FROM fg4"""


@q("face_gradient", _grad_sql(), digits=4)
def _(spark, sf):
    """Velocity of the density flow; near-degenerate faces amplify rounding, hence four digits."""
    fr = warped_frame(spark, sf)
    return fo.density_velocity(fr, fo.vertex_population_density(fr))


# ---------------------------------------------------------------- matrices


def _lap(pre: str, div: float, dt: float | None) -> str:
    la, lb, lc = slen("b", "c", pre), slen("c", "a", pre), slen("a", "b", pre)
    k = "1" if dt is None else f"({-dt / 2})"
    w = lambda p, q_, o: f"{k}*({p}*{p}+{q_}*{q_}-{o}*{o})/ha/{div}"
    return f"""
ln0 AS (SELECT mesh_id, a, b, c, {la} AS la, {lb} AS lb, {lc} AS lc FROM fc),
ln1 AS (SELECT *, sqrt(greatest((la+lb+lc)/2*((la+lb+lc)/2-la)*((la+lb+lc)/2-lb)*((la+lb+lc)/2-lc), 1e-300)) AS ha FROM ln0),
ln2 AS (SELECT *, {w('la', 'lb', 'lc')} AS ab, {w('lb', 'lc', 'la')} AS bc, {w('lc', 'la', 'lb')} AS ca FROM ln1),
tri AS (SELECT mesh_id, a AS row, b AS col, ab AS val FROM ln2 UNION ALL SELECT mesh_id, b, a, ab FROM ln2
 UNION ALL SELECT mesh_id, b, c, bc FROM ln2 UNION ALL SELECT mesh_id, c, b, bc FROM ln2
 UNION ALL SELECT mesh_id, c, a, ca FROM ln2 UNION ALL SELECT mesh_id, a, c, ca FROM ln2
 UNION ALL SELECT mesh_id, a, a, -ab-ca FROM ln2 UNION ALL SELECT mesh_id, b, b, -ab-bc FROM ln2 UNION ALL SELECT mesh_id, c, c, -bc-ca FROM ln2
 {'' if dt is None else 'UNION ALL SELECT mesh_id, v, v, m FROM (SELECT mesh_id, unnest([a, b, c]) AS v, ha/3 AS m FROM ln2)'}),
mat AS (SELECT mesh_id, row, col, sum(val) AS val FROM tri GROUP BY 1, 2, 3)"""


@q("cot_laplacian", "," + _lap("", 2.0, None) + f" SELECT mesh_id, row, col, {rnd('val')} FROM mat")
def _(spark, sf):
    return mx.cot_laplacian(exact_frame(spark, sf))


@q("mass_plus_laplacian", "," + _lap("t", 4.0, 0.1) + f" SELECT mesh_id, row, col, {rnd('val')} FROM mat")
def _(spark, sf):
    return mx.mass_plus_laplacian(warped_frame(spark, sf), 0.1)


_TUTTE = "," + HALF + """, tri AS (SELECT mesh_id, u AS row, w AS col, 0.5 AS val FROM he UNION ALL SELECT mesh_id, w, u, 0.5 FROM he
 UNION ALL SELECT mesh_id, u, u, -0.5 FROM he UNION ALL SELECT mesh_id, w, w, -0.5 FROM he)"""


@q("tutte_laplacian", _TUTTE + " SELECT mesh_id, row, col, CAST(sum(val) AS DOUBLE) AS val FROM tri GROUP BY 1, 2, 3", corners=False)
def _(spark, sf):
    return mx.tutte_laplacian(L(spark, sf).faces)


@q("triplet_sum", " SELECT mesh_id, c AS row, a AS col, " + rnd(f"sum({sarea()})", "val") + " FROM fc GROUP BY 1, 2, 3")
def _(spark, sf):
    fr = exact_frame(spark, sf)
    return mx.triplet_sum(fr.select("mesh_id", F.col("c").alias("row"), F.col("a").alias("col"), g.tri_area(vec("a"), vec("b"), vec("c")).alias("val")))


@q("spmv", "," + _lap("", 2.0, None) + f" SELECT m.mesh_id, m.row AS v, {rnd('sum(m.val*p.x)', 'x')}, {rnd('sum(m.val*p.y)', 'y')}, {rnd('sum(m.val*p.z)', 'z')} FROM mat m JOIN verts p ON p.mesh_id = m.mesh_id AND p.v = m.col GROUP BY 1, 2")
def _(spark, sf):
    m = L(spark, sf)
    return mx.spmv(mx.cot_laplacian(exact_frame(spark, sf)), m.vertices, ["x", "y", "z"])


# ---------------------------------------------------------------- chosen faces and rotations

_REG = f"""
rg AS (SELECT mesh_id, f, {sreg()} AS reg FROM fc),
mr AS (SELECT mesh_id, f, reg FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY reg, f) AS k FROM rg) WHERE k = 1)"""


@q("most_regular_triangle", "," + _REG + f" SELECT mesh_id, f, {rnd('reg')} FROM mr")
def _(spark, sf):
    return fo.most_regular_triangle(exact_frame(spark, sf))


@q("regular_triangle_avg", f""", ra AS (SELECT mesh_id, v, sum(reg)/3 AS rv FROM (SELECT mesh_id, {sreg('t')} AS reg, unnest([a, b, c]) AS v FROM fc) GROUP BY 1, 2),
rb AS (SELECT mesh_id, f, sum(rv)/3 AS reg FROM (SELECT mesh_id, f, unnest([a, b, c]) AS v FROM faces) JOIN ra USING (mesh_id, v) GROUP BY 1, 2)
SELECT mesh_id, f, {rnd('reg')} FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY reg, f) AS k FROM rb) WHERE k = 1""")
def _(spark, sf):
    return fo.regular_triangle_avg(warped_frame(spark, sf))


def _cen(pre: str) -> str:
    m = sscale(sadd(V("a" + pre), V("b" + pre), V("c" + pre)), "1.0/3")
    return f"cen AS (SELECT mesh_id, f, {', '.join(f'{x}/{snorm(m)} AS c{k}' for x, k in zip(m, 'xyz'))} FROM fc)"


@q("antipodal_face", "," + _REG + f""", {_cen('t')},
fa AS (SELECT c.mesh_id, c.f, (c.cx-r.cx)*(c.cx-r.cx)+(c.cy-r.cy)*(c.cy-r.cy)+(c.cz-r.cz)*(c.cz-r.cz) AS d2
 FROM cen c JOIN mr ON mr.mesh_id = c.mesh_id JOIN cen r ON r.mesh_id = mr.mesh_id AND r.f = mr.f)
SELECT mesh_id, f, {rnd('d2')} FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY d2 DESC, f) AS k FROM fa) WHERE k = 1""")
def _(spark, sf):
    fr = warped_frame(spark, sf)
    return fo.antipodal_face(fr, fo.most_regular_triangle(fr))


@q("rotation_to_north", "," + _REG + f""", {_cen('s')},
r0 AS (SELECT mesh_id, mr.f, cx, cy, cz, cx/sqrt(cx*cx+cy*cy) AS q, -cy/sqrt(cx*cx+cy*cy) AS s FROM mr JOIN cen USING (mesh_id, f)),
r1 AS (SELECT *, q*cx - s*cy AS b1 FROM r0), r2 AS (SELECT *, -b1/sqrt(b1*b1+cz*cz) AS sy, cz/sqrt(b1*b1+cz*cz) AS ch FROM r1),
r3 AS (SELECT mesh_id, f, ch*q AS m0, -ch*s AS m1, sy AS m2, s AS m3, q AS m4, 0.0::DOUBLE AS m5, -sy*q AS m6, sy*s AS m7, ch AS m8 FROM r2)
SELECT mesh_id, f, {', '.join(rnd(f'm{k}') for k in range(9))}, {', '.join(rnd(f'm{3 * (k % 3) + k // 3}', f'i{k}') for k in range(9))} FROM r3""")
def _(spark, sf):
    fr = exact_frame(spark, sf)
    return fo.rotation_of_face(fr, fo.most_regular_triangle(fr))


# ---------------------------------------------------------------- planar maps


def _st_s(pre):
    return f"{pre}x/(1+{pre}z)", f"{pre}y/(1+{pre}z)"


_SAFE = "WHERE f < 182"  # faces that do not touch the south pole, where the projection is infinite


def _plane(frame: DataFrame) -> DataFrame:
    cols = []
    for k in "abc":
        u, v = g.stereo_south(vec(k + "s"))
        cols += [u.alias(k + "u"), v.alias(k + "v")]
    return frame.select("*", *cols)


_BD_HEAD = f"""pl AS (SELECT *, {', '.join(f'{k}sx/(1+{k}sz) AS {k}u, {k}sy/(1+{k}sz) AS {k}v' for k in 'abc')} FROM fc WHERE c <> {NV + 1} AND b <> {NV + 1}),
pg AS (SELECT *, ((cu-bu)*(av-cv) - (au-cu)*(cv-bv))/2 AS par FROM pl),
ph AS (SELECT *, -(cv-bv)/(2*par) AS gxa, -(av-cv)/(2*par) AS gxb, -(bv-av)/(2*par) AS gxc,
  (cu-bu)/(2*par) AS gya, (au-cu)/(2*par) AS gyb, (bu-au)/(2*par) AS gyc FROM pg)"""
_MU_SURF = _BD_HEAD + f""",
pd AS (SELECT *, {', '.join(f'gxa*a{k}+gxb*b{k}+gxc*c{k} AS du{k}, gya*a{k}+gyb*b{k}+gyc*c{k} AS dv{k}' for k in 'xyz')} FROM ph),
pe AS (SELECT *, dux*dux+duy*duy+duz*duz AS ee, dvx*dvx+dvy*dvy+dvz*dvz AS gg, dux*dvx+duy*dvy+duz*dvz AS ff FROM pd),
mu AS (SELECT *, (ee-gg)/(ee+gg+2*sqrt(greatest(ee*gg-ff*ff, 0))) AS mu_re, 2*ff/(ee+gg+2*sqrt(greatest(ee*gg-ff*ff, 0))) AS mu_im FROM pe)"""


def _no_south(frame: DataFrame) -> DataFrame:
    """The south pole projects to infinity; its faces are left out, as a punctured map leaves them out."""
    s = NV + 1
    return frame.where((F.col("b") != s) & (F.col("c") != s))


@q("beltrami_coeff", f", {_MU_SURF} SELECT mesh_id, f, {rs('mu_re', 'mu_im')} FROM mu")
def _(spark, sf):
    return mx.beltrami_coeff(_plane(_no_south(exact_frame(spark, sf))))


@q("beltrami_triplets", f""", {_MU_SURF},
bt0 AS (SELECT *, (1-2*mu_re+mu_re*mu_re+mu_im*mu_im)/(1-mu_re*mu_re-mu_im*mu_im) AS al, -2*mu_im/(1-mu_re*mu_re-mu_im*mu_im) AS be,
  (1+2*mu_re+mu_re*mu_re+mu_im*mu_im)/(1-mu_re*mu_re-mu_im*mu_im) AS ga,
  bv-cv AS uxa, cv-av AS uxb, av-bv AS uxc, cu-bu AS uya, au-cu AS uyb, bu-au AS uyc FROM mu),
bt1 AS (SELECT *, abs(par) AS ha FROM bt0),
btr AS ({' UNION ALL '.join(f'SELECT mesh_id, {s} AS row, {t} AS col, (al*ux{s}*ux{t} + be*(ux{s}*uy{t}+ux{t}*uy{s}) + ga*uy{s}*uy{t})/ha/2 AS val FROM bt1' for s in 'abc' for t in 'abc')})
SELECT mesh_id, row, col, {rnd('sum(val)', 'val', 4)} FROM btr GROUP BY 1, 2, 3""", digits=4)
def _(spark, sf):
    pl = _plane(_no_south(exact_frame(spark, sf)))
    return mx.beltrami_triplets(pl, mx.beltrami_coeff(pl))


_CAP = f"""zr AS (SELECT mesh_id, v, row_number() OVER (PARTITION BY mesh_id ORDER BY -sz, v) - 1 AS rank, count(*) OVER (PARTITION BY mesh_id) AS n FROM verts),
cap AS (SELECT mesh_id, v FROM zr WHERE rank < greatest(floor(n/10.0+0.5), 3))"""


@q("beltrami_planar", f""", {_BD_HEAD}, {_CAP},
q0 AS (SELECT *, {', '.join(f'{k}tx/(1+{k}tz) AS {k}p, {k}ty/(1+{k}tz) AS {k}q' for k in 'abc')} FROM ph),
q1 AS (SELECT *, gxa*ap+gxb*bp+gxc*cp AS xr, gxa*aq+gxb*bq+gxc*cq AS xi, gya*ap+gyb*bp+gyc*cp AS yr, gya*aq+gyb*bq+gyc*cq AS yi FROM q0),
q2 AS (SELECT *, (xr+yi)/2 AS zr_, (xi-yr)/2 AS zi_, (xr-yi)/2 AS cr_, (xi+yr)/2 AS ci_ FROM q1),
q3 AS (SELECT *, (cr_*zr_+ci_*zi_)/(zr_*zr_+zi_*zi_) AS mr, (ci_*zr_-cr_*zi_)/(zr_*zr_+zi_*zi_) AS mi FROM q2)
SELECT mesh_id, count(*) FILTER (WHERE mr*mr+mi*mi >= 1 AND NOT EXISTS (SELECT 1 FROM cap WHERE cap.mesh_id = q3.mesh_id AND cap.v IN (a, b, c))) AS overlaps FROM q3 GROUP BY 1""")
def _(spark, sf):
    """Overlaps of the warped chart seen in the plane of the exact one, away from the north cap."""
    m = L(spark, sf)
    both = m.chart.select("mesh_id", "v", *named(vec("s"), "s")).join(
        m.warped.select("mesh_id", "v", *[F.col("s" + k).alias("t" + k) for k in "xyz"]), ["mesh_id", "v"])
    fr = _no_south(mo.face_corners(m.faces, both, ["sx", "sy", "sz", "tx", "ty", "tz"]))
    cols = []
    for k in "abc":
        u, v = g.stereo_south(vec(k + "s"))
        p, q_ = g.stereo_south(vec(k + "t"))
        cols += [u.alias(k + "u"), v.alias(k + "v"), p.alias(k + "p"), q_.alias(k + "q")]
    mu = mx.beltrami_planar(fr.select("*", *cols), "u", "v", "p", "q")
    cap = rank.lowest_share(m.chart, ["mesh_id"], "sz", "v", F.greatest(F.floor(F.col("n") / 10 + 0.5), F.lit(3)), highest=True)
    return mx.overlap_count(mu, cap)


@q("landmark_cap", f""", {_CAP.replace('-sz', 'sz')} SELECT mesh_id, v, rank FROM zr WHERE rank < greatest(floor(n/10.0+0.5), 3)""", corners=False)
def _(spark, sf):
    return rank.lowest_share(L(spark, sf).chart, ["mesh_id"], "sz", "v", F.greatest(F.floor(F.col("n") / 10 + 0.5), F.lit(3))).select("mesh_id", "v", "rank")


def _params(spark, sf) -> DataFrame:
    """25 candidate maps, one per nation."""
    n = F.col("n_nationkey")
    t = lambda k, s: (k + n % s * 0.05).cast("double")
    cols = [t(1, 5), t(0, 3), t(-0.1, 4), t(0, 2), t(0.02, 3), t(-0.05, 2), t(1, 4), t(0.01, 5)]
    return B.table(spark, sf, "nation").select(n.cast("int").alias("param_id"), *[c.alias(f"k{i}") for i, c in enumerate(cols)])


def _mobius_sql() -> str:
    k = [("1", 5), ("0", 3), ("-0.1", 4), ("0", 2), ("0.02", 3), ("-0.05", 2), ("1", 4), ("0.01", 5)]
    cols = ", ".join(f"CAST({b} + n_nationkey % {s} * 0.05 AS DOUBLE) AS k{i}" for i, (b, s) in enumerate(k))
    parts = []
    st = ["mesh_id", "param_id", "pa"]
    for c in "abc":
        st.append(f"k0*{c}u-k1*{c}w+k2 AS {c}nr, k0*{c}w+k1*{c}u+k3 AS {c}ni, k4*{c}u-k5*{c}w+k6 AS {c}dr, k4*{c}w+k5*{c}u+k7 AS {c}di, {c}inf")
    s2 = ", ".join(f"({c}nr*{c}dr+{c}ni*{c}di)/({c}dr*{c}dr+{c}di*{c}di) AS {c}p, ({c}ni*{c}dr-{c}nr*{c}di)/({c}dr*{c}dr+{c}di*{c}di) AS {c}q, {c}inf" for c in "abc")
    s3 = ", ".join(f"CASE WHEN {c}inf THEN 0 ELSE 2*{c}p/(1+{c}p*{c}p+{c}q*{c}q) END AS {c}mx, CASE WHEN {c}inf THEN 0 ELSE 2*{c}q/(1+{c}p*{c}p+{c}q*{c}q) END AS {c}my, CASE WHEN {c}inf THEN 1 ELSE ({c}p*{c}p+{c}q*{c}q-1)/(1+{c}p*{c}p+{c}q*{c}q) END AS {c}mz" for c in "abc")
    return f""", par AS (SELECT CAST(n_nationkey AS INTEGER) AS param_id, {cols} FROM nation),
fl AS (SELECT mesh_id, f, {sarea()} AS pa, {', '.join(f'CASE WHEN {c}sz = 1 THEN 0 ELSE {c}sx/(1-{c}sz) END AS {c}u, CASE WHEN {c}sz = 1 THEN 0 ELSE {c}sy/(1-{c}sz) END AS {c}w, {c}sz = 1 AS {c}inf' for c in 'abc')} FROM fc),
m1 AS (SELECT {', '.join(st)} FROM fl, par), m2 AS (SELECT mesh_id, param_id, pa, {s2} FROM m1), m3 AS (SELECT mesh_id, param_id, pa, {s3} FROM m2),
m4 AS (SELECT mesh_id, param_id, pa, {sarea('m')} AS sa FROM m3),
m5 AS (SELECT *, sum(sa) OVER (PARTITION BY mesh_id, param_id) AS st, sum(pa) OVER (PARTITION BY mesh_id, param_id) AS pt FROM m4),
obj AS (SELECT mesh_id, param_id, avg(abs(ln(sa/st/(pa/pt)))) AS obj FROM m5 WHERE sa > 0 AND pa > 0 GROUP BY 1, 2)
SELECT mesh_id, param_id, {rnd('obj')} FROM obj"""


@q("mobius_objective", _mobius_sql())
def _(spark, sf):
    """The pole at infinity maps back to the north pole, as the projection that sent it there."""
    return fo.mobius_objective(exact_frame(spark, sf), _params(spark, sf))


# ---------------------------------------------------------------- balanced energy


def _energy_ctes() -> str:
    A, Bv, C = V("as"), V("bs"), V("cs")
    cot = {"a": ("a", "b", "c"), "b": ("b", "c", "a"), "c": ("c", "a", "b")}
    cots = ", ".join(f"{sdot(ssub(V(q_), V(p)), ssub(V(r), V(p)))}/(2*ar) AS cot{k}" for k, (p, q_, r) in cot.items())
    sq = lambda p: sdot(p, p)
    return f""", e0 AS (SELECT *, {sarea()} AS ar FROM fc), et AS (SELECT mesh_id, sum(ar) AS att FROM e0 GROUP BY 1),
e1 AS (SELECT e0.*, ar/att AS w, 4*{PI}/att AS sc, {cots} FROM e0 JOIN et USING (mesh_id)),
e2 AS (SELECT *, -{svol('s')}/(2*ar)*-1 AS det, (cota*{sq(ssub(C, Bv))}+cotb*{sq(ssub(A, C))}+cotc*{sq(ssub(Bv, A))})/(2*ar) AS fro FROM e1)"""


@q("balanced_energy", _energy_ctes() + f" SELECT mesh_id, {rnd('sum(w*(0.5*fro/(2*det) + 0.25*(det/sc + sc/det)))', 'energy')} FROM e2 GROUP BY 1")
def _(spark, sf):
    return fo.balanced_energy(exact_frame(spark, sf))[0]


def _grad_energy() -> str:
    A, Bv, C = V("as"), V("bs"), V("cs")
    cb, ac, ba = ssub(C, Bv), ssub(A, C), ssub(Bv, A)
    rows = []
    for v, f1, d1, f2, d2, nrm in (("a", "cotb", ac, "cotc", ba, scross(Bv, C)), ("b", "cotc", ba, "cota", cb, scross(C, A)), ("c", "cota", cb, "cotb", ac, scross(A, Bv))):
        rows.append(f"SELECT mesh_id, {v} AS v, " + ", ".join(
            f"kf*({f1}*{x}-{f2}*{y})+kd*{z} AS g{k}" for k, x, y, z in zip("xyz", d1, d2, nrm)) + " FROM e3")
    return f""", e3 AS (SELECT *, w*0.5/(2*det)/ar AS kf, w*(-0.5*fro/(2*det*det)+0.25*(1/sc-sc/(det*det)))/(2*ar) AS kd FROM e2),
e4 AS (SELECT mesh_id, v, sum(gx) AS gx, sum(gy) AS gy, sum(gz) AS gz FROM ({' UNION ALL '.join(rows)}) GROUP BY 1, 2)
SELECT mesh_id, v, {', '.join(rnd(f'g{k} - (gx*sx+gy*sy+gz*sz)*s{k}', f'g{k}') for k in 'xyz')} FROM e4 JOIN verts USING (mesh_id, v)"""


@q("balanced_gradient", _energy_ctes() + _grad_energy())
def _(spark, sf):
    return fo.balanced_energy(exact_frame(spark, sf))[1]


@q("area_precond", f""", ap AS (SELECT mesh_id, v, sum(sa) AS sa, sum(pa) AS pa FROM (SELECT mesh_id, {sarea('t')} AS sa, {sarea()} AS pa, unnest([a, b, c]) AS v FROM fc) GROUP BY 1, 2)
SELECT mesh_id, v, {rnd('sa/(pa/tot)', 'h')} FROM ap JOIN (SELECT mesh_id, sum({sarea()}) AS tot FROM fc GROUP BY 1) USING (mesh_id)""")
def _(spark, sf):
    return fo.area_precond(warped_frame(spark, sf))


# ---------------------------------------------------------------- planar balance, depth, order


@q("top2_inner_triangle", f""", pl AS (SELECT mesh_id, f, {'+'.join(f'sqrt(pow({k}tx/(1+{k}tz),2)+pow({k}ty/(1+{k}tz),2))' for k in 'abc')} AS s FROM fc WHERE b <> {NV + 1} AND c <> {NV + 1})
SELECT mesh_id, f, k AS place, {rnd('s')} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY s, f) AS INTEGER) AS k FROM pl) WHERE k <= 2""")
def _(spark, sf):
    """Many faces are equally far out but for rounding, so the last bits are those of the C library, as in the SQL."""
    from orbtable.functions.libm import square
    from orbtable.operators.chart import innermost_faces
    fr = _no_south(warped_frame(spark, sf))
    return innermost_faces(fr, *[g.stereo_south(vec(k + "s")) for k in "abc"], square)


@q("median_edge", f""", ed AS (SELECT mesh_id, {slen('a', 'b')} AS e FROM fc UNION ALL SELECT mesh_id, {slen('b', 'c')} FROM fc UNION ALL SELECT mesh_id, {slen('c', 'a')} FROM fc),
er AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY e) - 1 AS k, count(*) OVER (PARTITION BY mesh_id) AS n FROM ed),
ex AS (SELECT mesh_id, max(greatest({', '.join(f'greatest(a{k},b{k},c{k})-least(a{k},b{k},c{k})' for k in 'xyz')})) AS ext FROM fc GROUP BY 1)
SELECT mesh_id, {rnd('max(CASE WHEN k = n//2 THEN e END)', 'med')}, {rnd('greatest(2*max(CASE WHEN k = n//2 THEN e END), max(ext)/8)', 'h')} FROM er JOIN ex USING (mesh_id) GROUP BY 1""")
def _(spark, sf):
    from orbtable.operators.spatial import median_edge
    return median_edge(exact_frame(spark, sf))


@q("arc_depth", f""", ar AS (SELECT mesh_id, f, {', '.join(f'2*asin(least(1.0, {slen(p, r, "t")}/2)) AS {p}{r}_' for p, r in ('ab', 'bc', 'ca'))} FROM fc)
SELECT mesh_id, f, {rnd('greatest(ab_, bc_, ca_)', 'arc')}, CAST(least(5, greatest(0, ceil(log2(greatest(ab_, bc_, ca_)/0.06)))) AS INTEGER) AS depth,
 {', '.join(f'CAST(least(256, greatest(1, ceil({p}{r}_/0.015))) AS INTEGER) AS seg_{p}{r}' for p, r in ('ab', 'bc', 'ca'))} FROM ar""")
def _(spark, sf):
    return fo.arc_depth(warped_frame(spark, sf))


@q("z_order", " SELECT mesh_id, v, row_number() OVER (PARTITION BY mesh_id ORDER BY z, v) - 1 AS place FROM verts", corners=False)
def _(spark, sf):
    return rank.number_by_value(L(spark, sf).vertices, ["mesh_id"], "z", "v", "place").select("mesh_id", "v", "place")


@q("mean_sq_displacement", f" SELECT mesh_id, {rnd('avg((sx-tx)*(sx-tx)+(sy-ty)*(sy-ty)+(sz-tz)*(sz-tz))', 'msd')} FROM verts GROUP BY 1", corners=False)
def _(spark, sf):
    from orbtable.operators.chart import mean_sq_displacement
    m = L(spark, sf)
    return mean_sq_displacement(m.warped, m.chart)


_CANON = """, t2 AS (SELECT mesh_id, f, CASE WHEN f % 4 = 0 THEN b ELSE a END AS a, CASE WHEN f % 4 = 0 THEN a ELSE b END AS b, CASE WHEN f % 7 = 0 THEN (c + 1) % 106 ELSE c END AS c FROM faces),
k1 AS (SELECT DISTINCT mesh_id, list_sort([a, b, c]) AS tri FROM faces), k2 AS (SELECT DISTINCT mesh_id, list_sort([a, b, c]) AS tri FROM t2)"""


def _altered(faces: DataFrame) -> DataFrame:
    f = F.col("f")
    return faces.select("mesh_id", "f", F.when(f % 4 == 0, F.col("b")).otherwise(F.col("a")).alias("a"),
                        F.when(f % 4 == 0, F.col("a")).otherwise(F.col("b")).alias("b"),
                        F.when(f % 7 == 0, (F.col("c") + 1) % 106).otherwise(F.col("c")).alias("c"))


@q("unique_triangles", _CANON + " SELECT mesh_id, tri[1] AS t0, tri[2] AS t1, tri[3] AS t2 FROM k2", corners=False)
def _(spark, sf):
    t = mo.canonical_triangles(_altered(L(spark, sf).faces))
    return t.select("mesh_id", *[F.col("tri")[i].alias(f"t{i}") for i in range(3)])


@q("triangle_set_overlap", _CANON + f""" SELECT mesh_id, common, n1, n2, {rnd('common/greatest(n1, n2)', 'overlap')} FROM
 (SELECT mesh_id, count(*) AS n1 FROM k1 GROUP BY 1) JOIN (SELECT mesh_id, count(*) AS n2 FROM k2 GROUP BY 1) USING (mesh_id)
 JOIN (SELECT mesh_id, count(*) AS common FROM k1 JOIN k2 USING (mesh_id, tri) GROUP BY 1) USING (mesh_id)""", corners=False)
def _(spark, sf):
    f = L(spark, sf).faces
    return mo.triangle_set_overlap(f, _altered(f))
