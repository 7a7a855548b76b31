"""Generators, projections, subdivision, and the fit of the supplier meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.catalog import register
from orbtable.catalog.meshes import L, q, rs
from orbtable.catalog.places import pts_cte, _gauss_rows
from orbtable.catalog.sqlkit import (
    ADJ, HALF, PI, TAU, V, analysis_cte, basis_cte, mesh_ctes, mesh_sql, rings_cte, rnd, scross, sdot, snorm, ssub, synth_cte, values,
)
from orbtable.functions import geometry as g
from orbtable.functions.vec import named, norm, scale, unit_columns, vec
from orbtable.operators import mesh as mo, rank, spectral as sp, surface as su
from orbtable.plans import fit as fp
from orbtable.session import dimension
from orbtable.sources import generate as gen

# analysis grid of the mesh fits: degree 3 with twofold oversampling
NLAT, NPHI, LMAX = 8, 16, 3


def suppliers(spark, sf) -> DataFrame:
    """One generated surface per supplier; its key sets the grid and its balance the shape."""
    s = F.col("s_suppkey")
    kinds = F.array(*[F.lit(k) for k in ("bumpy", "ellipsoid", "peanut", "sphere")])
    return B.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), s.cast("string")).alias("mesh_id"), (3 + s % 4).cast("int").alias("nlat"),
        (5 + s % 5).cast("int").alias("nphi"), kinds[(s % 4).cast("int")].alias("kind"), (s % 3).cast("int").alias("subdiv"))


_SUP = """sup AS (SELECT 's' || s_suppkey AS mesh_id, CAST(3 + s_suppkey % 4 AS INTEGER) AS nlat, CAST(5 + s_suppkey % 5 AS INTEGER) AS nphi,
 ['bumpy', 'ellipsoid', 'peanut', 'sphere'][1 + s_suppkey % 4] AS kind, s_suppkey % 3 AS subdiv FROM supplier)"""
_LATV = f"""lv AS (SELECT mesh_id, kind, range AS v, {PI}*(CASE WHEN range < nlat*nphi THEN range // nphi WHEN range = nlat*nphi THEN -1 ELSE nlat END + 1)/(nlat+1) AS th,
 CASE WHEN range < nlat*nphi THEN {TAU}*(range % nphi)/nphi ELSE 0 END AS ph FROM sup, range(200) WHERE range < nlat*nphi+2)"""
_SHAPE = {
    "x": "CASE kind WHEN 'ellipsoid' THEN sin(th)*cos(ph) WHEN 'peanut' THEN (1-0.6*sin(th)*sin(th))*sin(th)*cos(ph) ELSE r*sin(th)*cos(ph) END",
    "y": "CASE kind WHEN 'ellipsoid' THEN sin(th)*sin(ph) WHEN 'peanut' THEN (1-0.6*sin(th)*sin(th))*sin(th)*sin(ph) ELSE r*sin(th)*sin(ph) END",
    "z": "CASE kind WHEN 'ellipsoid' THEN 3*cos(th) WHEN 'peanut' THEN 1.4*(1-0.6*sin(th)*sin(th))*cos(th) ELSE r*cos(th) END",
}


@register("gen_shapes", f"""WITH {_SUP}, {_LATV}, lr AS (SELECT *, CASE kind WHEN 'bumpy' THEN 1+0.2*pow(sin(th),4)*cos(4*ph)+0.1*cos(3*th) ELSE 1 END AS r FROM lv)
SELECT mesh_id, v, {', '.join(rnd(e, k) for k, e in _SHAPE.items())} FROM lr""")
def _(spark, sf):
    return gen.latlong_mesh(suppliers(spark, sf))[0].select("mesh_id", "v", "x", "y", "z")


@register("gen_latlong", f"""WITH {_SUP}, lf AS (SELECT mesh_id, nlat, nphi, range AS f, 2*(nlat-1)*nphi AS body FROM sup, range(400) WHERE range < 2*nlat*nphi),
lc AS (SELECT *, CASE WHEN f < body THEN f // 2 ELSE (f - body) // 2 END AS cell FROM lf),
li AS (SELECT *, cell // nphi AS i, cell % nphi AS j, (cell % nphi + 1) % nphi AS j2 FROM lc)
SELECT mesh_id, f, CASE WHEN f < body THEN i*nphi + CASE WHEN f % 2 = 0 THEN j ELSE j2 END WHEN f % 2 = 0 THEN nlat*nphi ELSE (nlat-1)*nphi + j END AS a,
 CASE WHEN f < body THEN (i+1)*nphi + j WHEN f % 2 = 0 THEN j ELSE nlat*nphi + 1 END AS b,
 CASE WHEN f < body THEN CASE WHEN f % 2 = 0 THEN i*nphi + j2 ELSE (i+1)*nphi + j2 END WHEN f % 2 = 0 THEN j2 ELSE (nlat-1)*nphi + j2 END AS c FROM li""")
def _(spark, sf):
    return gen.latlong_mesh(suppliers(spark, sf))[1]


@register("gen_tensor_mesh", "WITH " + _gauss_rows(range(3, 7)) + f""", {_SUP}, tf AS (SELECT mesh_id, nlat, nphi, range AS f, 2*(nlat-1)*nphi AS body FROM sup, range(400) WHERE range < 2*nlat*nphi),
tc AS (SELECT *, CASE WHEN f < body THEN f // 2 // nphi ELSE 0 END AS i, CASE WHEN f < body THEN f // 2 % nphi ELSE (f - body) % nphi END AS j FROM tf),
tj AS (SELECT *, (j+1) % nphi AS j2 FROM tc)
SELECT mesh_id, f, CASE WHEN f < body THEN i*nphi + CASE WHEN f % 2 = 0 THEN j ELSE j2 END WHEN f < body + nphi THEN nlat*nphi ELSE (nlat-1)*nphi + j END AS a,
 CASE WHEN f < body THEN (i+1)*nphi + j WHEN f < body + nphi THEN j ELSE nlat*nphi + 1 END AS b,
 CASE WHEN f < body THEN CASE WHEN f % 2 = 0 THEN i*nphi + j2 ELSE (i+1)*nphi + j2 END WHEN f < body + nphi THEN j2 ELSE (nlat-1)*nphi + j2 END AS c FROM tj""")
def _(spark, sf):
    return gen.tensor_faces(suppliers(spark, sf))


@register("grid_directions", "WITH " + _gauss_rows(range(3, 7)) + f""", {_SUP}
SELECT mesh_id, CAST(i*nphi + range AS BIGINT) AS v, {rnd(f'sin(theta)*cos({TAU}*range/nphi)', 'x')}, {rnd(f'sin(theta)*sin({TAU}*range/nphi)', 'y')}, {rnd('cos(theta)', 'z')}
FROM sup JOIN gth ON n = nlat, range(20) WHERE range < nphi
UNION ALL SELECT mesh_id, nlat*nphi, 0.0, 0.0, 1.0 FROM sup UNION ALL SELECT mesh_id, nlat*nphi + 1, 0.0, 0.0, -1.0 FROM sup""")
def _(spark, sf):
    """Grid directions of every supplier's Gauss grid and the two caps."""
    cfg = suppliers(spark, sf)
    return gen.tensor_vertices(cfg, sp.rings_for(cfg))


def _ico_sql() -> str:
    v = [(k, *[float(c) / (sum(t * t for t in p) ** 0.5) for c in p]) for k, p in enumerate(gen.ICO_VERTICES)]
    f = [(k, *t) for k, t in enumerate(gen.ICO_FACES)]
    out = "WITH " + values("v0", "v, x, y, z", v) + "," + values("f0", "f, a, b, c", f)
    for r in range(2):
        out += f""", h{r} AS (SELECT 3*f AS ord, f, 0 AS k, a AS u, b AS w FROM f{r} UNION ALL SELECT 3*f+1, f, 1, b, c FROM f{r} UNION ALL SELECT 3*f+2, f, 2, c, a FROM f{r}),
e{r} AS (SELECT lo, hi, (SELECT count(*) FROM v{r}) + row_number() OVER (ORDER BY o) - 1 AS id FROM (SELECT least(u,w) AS lo, greatest(u,w) AS hi, min(ord) AS o FROM h{r} GROUP BY 1, 2)),
m{r} AS (SELECT id AS v, p.x+q.x AS x, p.y+q.y AS y, p.z+q.z AS z FROM e{r} JOIN v{r} p ON p.v = lo JOIN v{r} q ON q.v = hi),
v{r + 1} AS (SELECT v, x, y, z FROM v{r} UNION ALL SELECT v, x/sqrt(x*x+y*y+z*z), y/sqrt(x*x+y*y+z*z), z/sqrt(x*x+y*y+z*z) FROM m{r}),
s{r} AS (SELECT f.f, f.a, f.b, f.c, max(CASE WHEN k = 0 THEN id END) AS ab, max(CASE WHEN k = 1 THEN id END) AS bc, max(CASE WHEN k = 2 THEN id END) AS ca
 FROM f{r} f JOIN h{r} h ON h.f = f.f JOIN e{r} ON lo = least(u,w) AND hi = greatest(u,w) GROUP BY ALL),
f{r + 1} AS (SELECT 4*f AS f, a, ab AS b, ca AS c FROM s{r} UNION ALL SELECT 4*f+1, b, bc, ab FROM s{r} UNION ALL SELECT 4*f+2, c, ca, bc FROM s{r} UNION ALL SELECT 4*f+3, ab, bc, ca FROM s{r})"""
    every = " UNION ALL ".join(f"SELECT {r} AS d, * FROM v{r}" for r in range(3))
    return out + f", {_SUP}, ev AS ({every}) SELECT mesh_id, CAST(v AS BIGINT) AS v, {rs('x', 'y', 'z')} FROM sup JOIN ev ON d = subdiv"


@register("gen_icosphere", _ico_sql())
def _(spark, sf):
    return gen.icosphere(suppliers(spark, sf))[0]


@register("gen_golden_spiral", f"""SELECT 's' || s_suppkey AS cloud_id, range AS p, {', '.join(rnd(f'r*{e}', k) for k, e in (('x', 'sin(th)*cos(ph)'), ('y', 'sin(th)*sin(ph)'), ('z', 'cos(th)')))}
FROM (SELECT *, 1+0.1*sin(3*th)*cos(4*ph) AS r FROM (SELECT s_suppkey, range, acos(1-2*(range+0.5)/n) AS th, range*2.399963229728653 AS ph
 FROM (SELECT s_suppkey, 40 + s_suppkey % 60 AS n FROM supplier), range(100) WHERE range < n))""")
def _(spark, sf):
    s = F.col("s_suppkey")
    return gen.golden_spiral(B.table(spark, sf, "supplier").select(F.concat(F.lit("s"), s.cast("string")).alias("cloud_id"), (40 + s % 60).alias("n")))


@register("reliable_rows", "WITH " + _gauss_rows(range(2, 13)) + f" SELECT s_suppkey, i, {rnd('theta')} FROM supplier JOIN gth ON n = 2 + s_suppkey % 11 WHERE sin(theta) >= 0.2")
def _(spark, sf):
    cfg = B.table(spark, sf, "supplier").select("s_suppkey", (2 + F.col("s_suppkey") % 11).cast("int").alias("nlat"))
    return cfg.join(fp.reliable_rows(sp.rings_for(cfg)), "nlat").select("s_suppkey", "i", "theta")


# ---------------------------------------------------------------- projections of the embedding directions

_DIR = "WITH " + pts_cte() + ", dr AS (SELECT cloud_id, p, x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM pts)"


def directions(spark, sf) -> DataFrame:
    return B.embedding_points(spark, sf).select("cloud_id", "p", *unit_columns(vec(""), ""))


@register("unit_rows", _DIR + f" SELECT cloud_id, p, {rs('x', 'y', 'z')} FROM dr")
def _(spark, sf):
    return directions(spark, sf)


@register("stereo_north", _DIR + f" SELECT cloud_id, p, {rnd('x/(1-z)', 'u')}, {rnd('y/(1-z)', 'w')} FROM dr")
def _(spark, sf):
    u, w = g.stereo_north(vec(""))
    return directions(spark, sf).select("cloud_id", "p", u.alias("u"), w.alias("w"))


@register("stereo_south", _DIR + f" SELECT cloud_id, p, {rnd('x/(1+z)', 'u')}, {rnd('y/(1+z)', 'w')} FROM dr")
def _(spark, sf):
    u, w = g.stereo_south(vec(""))
    return directions(spark, sf).select("cloud_id", "p", u.alias("u"), w.alias("w"))


@register("unstereo", "WITH " + pts_cte() + f""" SELECT cloud_id, p, {rnd('2*x/(1+x*x+y*y)', 'sx')}, {rnd('2*y/(1+x*x+y*y)', 'sy')}, {rnd('(x*x+y*y-1)/(1+x*x+y*y)', 'sz')},
 {rnd('(1-x*x-y*y)/(1+x*x+y*y)', 'flipped')} FROM pts""")
def _(spark, sf):
    """The first two embedding coordinates as a plane."""
    up = g.unstereo(F.col("x"), F.col("y"))
    return B.embedding_points(spark, sf).select("cloud_id", "p", *named(up, "s"), g.unstereo(F.col("x"), F.col("y"), True)[2].alias("flipped"))


@register("mobius_apply", "WITH " + pts_cte() + f""", k AS (SELECT *, 1+0.1*CAST(cloud_id AS INTEGER) AS ar, 0.2 AS ai, 0.3 AS br, -0.1*CAST(cloud_id AS INTEGER) AS bi, 0.4 AS cr, 0.0 AS ci, 1.5 AS dr, 0.25 AS di FROM pts),
n AS (SELECT cloud_id, p, ar*x-ai*y+br AS nr, ar*y+ai*x+bi AS ni, cr*x-ci*y+dr AS dr, cr*y+ci*x+di AS di FROM k)
SELECT cloud_id, p, {rnd('(nr*dr+ni*di)/(dr*dr+di*di)', 'u')}, {rnd('(ni*dr-nr*di)/(dr*dr+di*di)', 'w')} FROM n""")
def _(spark, sf):
    """One Moebius map per cloud, from a parameter table joined by cloud."""
    pts = B.embedding_points(spark, sf)
    lab = F.col("cloud_id").cast("int")
    par = pts.select("cloud_id").distinct().select("cloud_id", (1 + 0.1 * lab).alias("k0"), F.lit(0.2).alias("k1"), F.lit(0.3).alias("k2"), (-0.1 * lab).alias("k3"),
        F.lit(0.4).alias("k4"), F.lit(0.0).alias("k5"), F.lit(1.5).alias("k6"), F.lit(0.25).alias("k7"))
    u, w = g.mobius(F.col("x"), F.col("y"), [F.col(f"k{i}") for i in range(8)])
    return pts.join(par, "cloud_id").select("cloud_id", "p", u.alias("u"), w.alias("w"))


_ALIGN = _DIR + """, d0 AS (SELECT cloud_id, x, y, z, sqrt(x*x+y*y) AS s FROM dr WHERE (cloud_id, p) IN (SELECT (cloud_id, min(p)) FROM dr GROUP BY cloud_id)),
d1 AS (SELECT cloud_id, y/s AS kx, -x/s AS ky, z AS c, s FROM d0),
mt AS (SELECT cloud_id, c+kx*kx*(1-c) AS m0, kx*ky*(1-c) AS m1, ky*s AS m2, kx*ky*(1-c) AS m3, c+ky*ky*(1-c) AS m4, -kx*s AS m5, -ky*s AS m6, kx*s AS m7, c AS m8 FROM d1)"""


def _matrices(d: DataFrame) -> DataFrame:
    """Per cloud: the rotation taking its first direction to +z."""
    first = d.groupBy("cloud_id").agg(F.min(F.struct("p", "x", "y", "z")).alias("m")).select("cloud_id", "m.x", "m.y", "m.z")
    return first.select("cloud_id", *[c.alias(f"m{i}") for i, c in enumerate(g.align_to_z(vec("")))])


@register("align_to_z", _ALIGN + f" SELECT cloud_id, {rs(*[f'm{i}' for i in range(9)])} FROM mt")
def _(spark, sf):
    return _matrices(directions(spark, sf))


@register("rotate3", _ALIGN + f" SELECT cloud_id, p, {rnd('m0*x+m1*y+m2*z', 'x')}, {rnd('m3*x+m4*y+m5*z', 'y')}, {rnd('m6*x+m7*y+m8*z', 'z')} FROM dr JOIN mt USING (cloud_id)")
def _(spark, sf):
    d = directions(spark, sf)
    return d.join(_matrices(d), "cloud_id").select("cloud_id", "p", *named(g.rotate(vec(""), [F.col(f"m{i}") for i in range(9)]), ""))


@register("polar_cap_fixed", _DIR + """, zr AS (SELECT cloud_id, p, row_number() OVER (PARTITION BY cloud_id ORDER BY z, p) - 1 AS lo, row_number() OVER (PARTITION BY cloud_id ORDER BY -z, p) - 1 AS hi, count(*) OVER (PARTITION BY cloud_id) AS n FROM dr)
SELECT cloud_id, p, 'south' AS cap, lo AS rank FROM zr WHERE lo < floor(n*0.2) UNION ALL SELECT cloud_id, p, 'north', hi FROM zr WHERE hi < floor(n*0.2)""")
def _(spark, sf):
    d = directions(spark, sf)
    take = F.floor(F.col("n") * 0.2)
    side = lambda top, name: rank.lowest_share(d, ["cloud_id"], "z", "p", take, highest=top).select("cloud_id", "p", F.lit(name).alias("cap"), "rank")
    return side(False, "south").unionByName(side(True, "north"))


@register("extreme_poles", _DIR + """ SELECT cloud_id, (SELECT p FROM dr d WHERE d.cloud_id = g.cloud_id ORDER BY z DESC, p LIMIT 1) AS north,
 (SELECT p FROM dr d WHERE d.cloud_id = g.cloud_id ORDER BY z, p LIMIT 1) AS south FROM (SELECT DISTINCT cloud_id FROM dr) g""")
def _(spark, sf):
    from orbtable.operators.cloud import extreme_poles
    return extreme_poles(directions(spark, sf))


# ---------------------------------------------------------------- subdivision


def _loop_ctes(cols=("x", "y", "z")) -> str:
    beta = f"(CASE WHEN n = 3 THEN 0.1875 ELSE (0.625 - pow(0.375 + cos({TAU}/n)/4, 2))/n END)"
    return "," + ADJ + f""", ns AS (SELECT a.mesh_id, a.v, count(*) AS n, {', '.join(f'sum(p.{c}) AS m{c}' for c in cols)} FROM adj a JOIN verts p ON p.mesh_id = a.mesh_id AND p.v = a.u GROUP BY 1, 2),
nb AS (SELECT *, {beta} AS be FROM ns),
en AS (SELECT e.*, (SELECT count(*) FROM verts v WHERE v.mesh_id = 's0') + row_number() OVER (PARTITION BY mesh_id ORDER BY ord) - 1 AS id FROM edges e),
fine AS (SELECT mesh_id, v, {', '.join(f'(1-n*be)*{c} + be*m{c} AS {c}' for c in cols)} FROM verts JOIN nb USING (mesh_id, v)
 UNION ALL SELECT e.mesh_id, e.id, {', '.join(f'0.375*(p.{c}+q.{c}) + 0.125*(r.{c}+s.{c})' for c in cols)} FROM en e
 JOIN verts p ON p.mesh_id = e.mesh_id AND p.v = e.lo JOIN verts q ON q.mesh_id = e.mesh_id AND q.v = e.hi JOIN verts r ON r.mesh_id = e.mesh_id AND r.v = e.opp1 JOIN verts s ON s.mesh_id = e.mesh_id AND s.v = e.opp2)"""


@q("loop_subdivide", _loop_ctes() + f" SELECT mesh_id, v, {rs('x', 'y', 'z')} FROM fine", corners=False)
def _(spark, sf):
    m = L(spark, sf)
    return su.loop_subdivide(m.vertices, m.faces, m.chart)[0]


@q("loop_subdivide_chart", _loop_ctes(("sx", "sy", "sz")) + f" SELECT mesh_id, v, {', '.join(rnd(f's{k}/sqrt(sx*sx+sy*sy+sz*sz)', f's{k}') for k in 'xyz')} FROM fine", corners=False)
def _(spark, sf):
    m = L(spark, sf)
    return su.loop_subdivide(m.vertices, m.faces, m.chart)[2]


@q("loop_subdivide_faces", _loop_ctes() + """, fh AS (SELECT h.mesh_id, h.f, h.k, h.u, e.id FROM (SELECT *, least(u, w) AS lo, greatest(u, w) AS hi FROM he) h
 JOIN en e ON e.mesh_id = h.mesh_id AND e.lo = h.lo AND e.hi = h.hi),
sp AS (SELECT mesh_id, f, max(CASE WHEN k = 0 THEN u END) AS a, max(CASE WHEN k = 1 THEN u END) AS b, max(CASE WHEN k = 2 THEN u END) AS c,
 max(CASE WHEN k = 0 THEN id END) AS ab, max(CASE WHEN k = 1 THEN id END) AS bc, max(CASE WHEN k = 2 THEN id END) AS ca FROM fh GROUP BY 1, 2)
SELECT mesh_id, 4*f AS f, a, ab AS b, ca AS c FROM sp UNION ALL SELECT mesh_id, 4*f+1, ab, b, bc FROM sp UNION ALL SELECT mesh_id, 4*f+2, ca, bc, c FROM sp UNION ALL SELECT mesh_id, 4*f+3, ab, bc, ca FROM sp""", corners=False)
def _(spark, sf):
    m = L(spark, sf)
    return su.loop_subdivide_field(m.faces, m.vertices, ["x"])[1]


@q("loop_subdivide_field", _loop_ctes(("r",)).replace("FROM adj a JOIN verts p", "FROM adj a JOIN vr p").replace("FROM verts JOIN nb", "FROM vr JOIN nb").replace("JOIN verts", "JOIN vr").replace(
    ", ns AS", ", vr AS (SELECT mesh_id, v, exp(sqrt(x*x+y*y+z*z)) AS r FROM verts), ns AS") + f" SELECT mesh_id, v, {rnd('r')} FROM fine", corners=False)
def _(spark, sf):
    """exp(radius) as a scalar field on the mesh."""
    m = L(spark, sf)
    return su.loop_subdivide_field(m.faces, m.vertices.select("mesh_id", "v", F.exp(norm(vec(""))).alias("r")), ["r"])[0]


@q("limit_vertex", _loop_ctes() + f""", lw AS (SELECT *, 1/(n + 3/(8*be)) AS om FROM nb) SELECT mesh_id, v, {', '.join(rnd(f'(1-n*om)*{k} + om*m{k}', k) for k in 'xyz')} FROM verts JOIN lw USING (mesh_id, v)""", corners=False)
def _(spark, sf):
    m = L(spark, sf)
    return su.limit_vertex(m.vertices, m.faces, ["x", "y", "z"])


@register("limit_sampling")
def _(spark, sf):
    """Smooth surface at the fit grid after one refinement; the tests check it on the sphere."""
    m = L(spark, sf)
    return su.limit_sampling(m.vertices, m.faces, m.chart, fp.grid_directions(m.chart, NLAT, NPHI))


# ---------------------------------------------------------------- the fit and what follows from it


def mesh_grid(spark, sf) -> DataFrame:
    m = L(spark, sf)
    return dimension(spark, ("mesh_grid", sf), lambda: fp.resample_to_grid(m.vertices, m.faces, m.chart, NLAT, NPHI))


def mesh_coeffs(spark, sf) -> DataFrame:
    return dimension(spark, ("mesh_coeffs", sf), lambda: sp.sh_analysis(fp.as_fields(mesh_grid(spark, sf)), NLAT, NPHI, LMAX))


def _grid_ctes() -> str:
    a, b, c = V("as"), V("bs"), V("cs")
    p = ("g.gx", "g.gy", "g.gz")
    vol = lambda u, v, w: sdot(u, scross(v, w))
    return "," + rings_cte(NLAT) + "," + basis_cte(LMAX) + f""",
gd AS (SELECT i, CAST(range AS INTEGER) AS j, st*cos({TAU}*range/{NPHI}) AS gx, st*sin({TAU}*range/{NPHI}) AS gy, ct AS gz FROM rings, range({NPHI})),
rw AS (SELECT fc.*, g.i, g.j, {vol(a, b, c)} AS det, {vol(p, b, c)} AS n0, {vol(a, p, c)} AS n1, {vol(a, b, p)} AS n2 FROM fc, gd g),
rx AS (SELECT *, n0/det AS u0, n1/det AS u1, n2/det AS u2 FROM rw WHERE abs(det) >= 1e-14),
ry AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, i, j ORDER BY f) AS k, u0/(u0+u1+u2) AS w0, u1/(u0+u1+u2) AS w1, u2/(u0+u1+u2) AS w2 FROM rx WHERE u0 >= -1e-12 AND u1 >= -1e-12 AND u2 >= -1e-12),
grid AS MATERIALIZED (SELECT mesh_id, i, j, {', '.join(f'w0*a{k}+w1*b{k}+w2*c{k} AS {k}' for k in 'xyz')} FROM ry WHERE k = 1),
samples AS (SELECT mesh_id AS field_id, 'x' AS comp, i, j, x AS f FROM grid UNION ALL SELECT mesh_id, 'y', i, j, y FROM grid UNION ALL SELECT mesh_id, 'z', i, j, z FROM grid),""" + analysis_cte(
        "samples", NPHI, mmax=LMAX).replace("\ncoeffs AS (", "\ncoeffs AS MATERIALIZED (")


def fitq(name, tail, **kw):
    return q(name, _grid_ctes() + tail, recursive=True, **kw)


@fitq("resample_to_grid", f" SELECT mesh_id, i, j, {rs('x', 'y', 'z')} FROM grid")
def _(spark, sf):
    m = L(spark, sf)
    return fp.resample_to_grid(m.vertices, m.faces, m.chart, NLAT, NPHI)


@fitq("fit", f""" SELECT field_id, l, {rnd('sum(CASE WHEN m = 0 THEN 1 ELSE 2 END*(re*re+im*im))', 'p')} FROM coeffs GROUP BY 1, 2""")
def _(spark, sf):
    """Mesh to power spectrum: locate, resample, analyse."""
    m = L(spark, sf)
    return sp.power_spectrum(fp.fit(m.vertices, m.faces, m.chart, NLAT, NPHI, LMAX)[1])


_PARS = f""", pf AS (SELECT field_id, {', '.join(f"sum(CASE WHEN l = 0 AND comp = '{k}' THEN re END)/(2*sqrt({PI})) AS c{k}" for k in 'xyz')},
 sqrt(sum(CASE WHEN l = 0 THEN 0 WHEN m = 0 THEN re*re+im*im ELSE 2*(re*re+im*im) END)/(4*{PI})) AS scale FROM coeffs GROUP BY 1)"""


@fitq("parseval_normalise", _PARS + f" SELECT field_id AS mesh_id, {rs('cx', 'cy', 'cz', 'scale')} FROM pf")
def _(spark, sf):
    return sp.parseval_normalise(mesh_coeffs(spark, sf))[0].withColumnRenamed("field_id", "mesh_id")


@fitq("normalised_coeffs", _PARS + f" SELECT c.field_id, comp, l, m, {rnd('CASE WHEN l = 0 THEN 0.0 ELSE re/scale END', 're')}, {rnd('CASE WHEN l = 0 THEN 0.0 ELSE im/scale END', 'im')} FROM coeffs c JOIN pf ON pf.field_id = c.field_id")
def _(spark, sf):
    return sp.parseval_normalise(mesh_coeffs(spark, sf))[1]


def region_specs(spark, sf) -> DataFrame:
    """One filter of each kind, from the five regions."""
    r = F.col("r_regionkey")
    kinds = F.array(*[F.lit(k) for k in ("none", "hard", "fraction", "trapeziform", "gaussian")])
    return B.table(spark, sf, "region").select(
        kinds[r].alias("spec_id"), kinds[r].alias("kind"), F.lit(1.0).alias("cutoff"), F.lit(2.0).alias("ramp"), F.lit(0.6).alias("sigma"), F.lit(4.0).alias("r"))


def _filtered_ctes() -> str:
    from orbtable.catalog.sqlkit import gains_cte
    return f""", specs AS (SELECT ['none', 'hard', 'fraction', 'trapeziform', 'gaussian'][1 + r_regionkey] AS spec_id, ['none', 'hard', 'fraction', 'trapeziform', 'gaussian'][1 + r_regionkey] AS kind,
 1.0 AS cutoff, 2.0 AS ramp, 0.6 AS sigma, 4.0 AS r FROM region), {gains_cte(LMAX)},
fq AS (SELECT c.field_id, g.spec_id, c.comp, c.l, c.m, c.re*g.g AS re, c.im*g.g AS im FROM coeffs c JOIN gains g ON g.l = c.l),""" + synth_cte("fq", NPHI, "fs", keys="field_id, spec_id, comp") + f""",
fw AS (SELECT field_id AS mesh_id, spec_id, i, j, {', '.join(f"max(CASE WHEN comp = '{k}' THEN f END) AS {k}" for k in 'xyz')} FROM fs GROUP BY 1, 2, 3, 4)"""


@fitq("filter_and_evaluate", _filtered_ctes() + f" SELECT mesh_id, spec_id, i, j, {rs('x', 'y', 'z')} FROM fw")
def _(spark, sf):
    return fp.filter_and_evaluate(mesh_coeffs(spark, sf), sp.gains_for(region_specs(spark, sf), LMAX), NLAT, NPHI, LMAX)


@fitq("residual_metrics", _filtered_ctes() + f""", dg AS (SELECT mesh_id, sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)+pow(max(z)-min(z),2)) AS diag FROM verts GROUP BY 1),
rd AS (SELECT f.mesh_id, spec_id, (f.x-g.x)*(f.x-g.x)+(f.y-g.y)*(f.y-g.y)+(f.z-g.z)*(f.z-g.z) AS d2 FROM fw f JOIN grid g ON g.mesh_id = f.mesh_id AND g.i = f.i AND g.j = f.j)
SELECT mesh_id, spec_id, {rnd('100*sqrt(avg(d2))/max(diag)', 'rms_pct')}, {rnd('100*sqrt(max(d2))/max(diag)', 'max_pct')} FROM rd JOIN dg USING (mesh_id) GROUP BY 1, 2""")
def _(spark, sf):
    gains = sp.gains_for(region_specs(spark, sf), LMAX)
    return fp.filter_residuals(mesh_coeffs(spark, sf), gains, mesh_grid(spark, sf), L(spark, sf).vertices, NLAT, NPHI, LMAX)


@register("grid_metrics")
def _(spark, sf):
    """Fit of degree 1 against the input on the tensor grid; the tests check its intersection count on triangle soup."""
    hard = region_specs(spark, sf).where("kind = 'hard'")
    e = fp.filter_and_evaluate(mesh_coeffs(spark, sf), sp.gains_for(hard, LMAX), NLAT, NPHI, LMAX)
    return fp.grid_metrics(e.drop("spec_id"), mesh_grid(spark, sf), NLAT, NPHI)


_CAPS = f"""SELECT mesh_id, CAST(i*{NPHI}+j AS BIGINT) AS v, x, y, z FROM grid UNION ALL
SELECT mesh_id, CASE WHEN i = 0 THEN {NLAT * NPHI} ELSE {NLAT * NPHI + 1} END, avg(x), avg(y), avg(z) FROM grid WHERE i IN (0, {NLAT - 1}) GROUP BY mesh_id, i"""


@fitq("cap_join", f", tp AS ({_CAPS}) SELECT mesh_id, v, {rs('x', 'y', 'z')} FROM tp")
def _(spark, sf):
    return fp.tensor_points(mesh_grid(spark, sf), NLAT, NPHI)


@fitq("morph_to_sphere", f""", tp AS ({_CAPS}), rr AS (SELECT mesh_id, sqrt(avg(x*x+y*y+z*z)) AS rad FROM grid GROUP BY 1),
sd AS (SELECT i*{NPHI}+j AS v, gx, gy, gz FROM gd UNION ALL VALUES ({NLAT * NPHI}, 0.0, 0.0, 1.0), ({NLAT * NPHI + 1}, 0.0, 0.0, -1.0))
SELECT mesh_id, tp.v, {', '.join(rnd(f'0.7*rad*g{k} + 0.3*{k}', k) for k in 'xyz')} FROM tp JOIN rr USING (mesh_id) JOIN sd ON sd.v = tp.v""")
def _(spark, sf):
    return fp.morph_to_sphere(mesh_grid(spark, sf), NLAT, NPHI, 0.3)


def _curv_ctes() -> str:
    up = lambda l: f"(({l}) * sqrt(((({l})-m+1)*(({l})+m+1))/((2.0*({l})+1)*(2*({l})+3))))"
    dn = lambda l: f"(-(({l})+1) * sqrt(((({l})-m)*(({l})+m))/((2.0*({l})-1)*(2*({l})+1))))"

    def sdt(src, out):
        side = lambda k: f"CASE WHEN l > m THEN {up('l-1')} ELSE 0 END * coalesce(lag({k}) OVER w, 0) + {dn('l+1')} * coalesce(lead({k}) OVER w, 0) AS {k}"
        return f"{out} AS (SELECT field_id, comp, l, m, {side('re')}, {side('im')} FROM {src} WINDOW w AS (PARTITION BY field_id, comp, m ORDER BY l))"

    dph = lambda src, out: f"{out} AS (SELECT field_id, comp, l, m, -m*im AS re, m*re AS im FROM {src})"
    ctes = ", " + ", ".join([sdt("coeffs", "qat"), sdt("qat", "qatt"), dph("qat", "qatp"), dph("coeffs", "qxp"), dph("qxp", "qxpp")])
    every = " UNION ALL ".join(f"SELECT field_id, '{n}_' || comp AS comp, l, m, re, im FROM {t}" for n, t in (("At", "qat"), ("Att", "qatt"), ("Atp", "qatp"), ("xp", "qxp"), ("xpp", "qxpp")))
    names = [f"{n}_{k}" for n in ("At", "Att", "Atp", "xp", "xpp") for k in "xyz"]
    v = lambda n: tuple(f'"{n}_{k}"' for k in "xyz")
    nn = scross(v("At"), v("xp"))
    n = V("n")
    sec = tuple(f"({a}-ct*{b})" for a, b in zip(v("Att"), v("At")))
    return ctes + f", qall AS ({every})," + synth_cte("qall", NPHI, "ds") + f""",
dw AS (SELECT field_id, i, j, {', '.join(f"max(CASE WHEN comp = '{c}' THEN f END) AS " + '"' + c + '"' for c in names)} FROM ds GROUP BY 1, 2, 3),
dn AS (SELECT dw.*, r.ct, {', '.join(f'{e} AS n{k}' for e, k in zip(nn, 'xyz'))} FROM dw JOIN rings r ON r.i = dw.i),
dc AS (SELECT field_id, i, j, {sdot(v('At'), v('At'))} AS ee, {sdot(v('At'), v('xp'))} AS ff, {sdot(v('xp'), v('xp'))} AS gg,
 {sdot(sec, n)}/{snorm(n)} AS lh, {sdot(v('Atp'), n)}/{snorm(n)} AS mh, {sdot(v('xpp'), n)}/{snorm(n)} AS nh FROM dn),
curv AS (SELECT field_id, i, j, -(ee*nh-2*ff*mh+gg*lh)/(2*(ee*gg-ff*ff)) AS h, (lh*nh-mh*mh)/(ee*gg-ff*ff) AS k FROM dc)"""


@fitq("curvature", _curv_ctes() + f" SELECT field_id AS mesh_id, i, j, {rs('h', 'k')} FROM curv")
def _(spark, sf):
    """Mean and Gauss curvature of the fitted surfaces, pointwise."""
    return fp.pointwise_curvature(fp.derivative_fields(mesh_coeffs(spark, sf), NLAT, NPHI, LMAX), NLAT).withColumnRenamed("field_id", "mesh_id")


@fitq("curvature_band", _curv_ctes() + """, cs AS (SELECT field_id, 'c' AS comp, i, j, h AS f FROM curv),""" + analysis_cte("cs", NPHI, "cq", mmax=LMAX) + "," + synth_cte("cq", NPHI, "cb")
      + f" SELECT field_id, i, j, {rnd('f')} FROM cb")
def _(spark, sf):
    """Mean curvature filtered to the band of the surface (every ring of this grid is reliable)."""
    return fp.curvature(mesh_coeffs(spark, sf), NLAT, NPHI, LMAX)


@fitq("curvature_error", _curv_ctes() + f" SELECT field_id, {rnd('sqrt(avg((h-1)*(h-1)))', 'rms')}, {rnd('max(abs(h-1))', 'max')} FROM curv GROUP BY 1")
def _(spark, sf):
    return fp.curvature_error(fp.pointwise_curvature(fp.derivative_fields(mesh_coeffs(spark, sf), NLAT, NPHI, LMAX), NLAT))


@register("cap_row_fill", "WITH " + rings_cte(16) + """, ec AS (SELECT event_type AS field_id, CAST(user_id % 16 AS INTEGER) AS i, CAST(event_id % 8 AS INTEGER) AS j, sum(value) AS f FROM events GROUP BY 1, 2, 3),
src AS (SELECT i, greatest((SELECT min(i) FROM rings WHERE st >= 0.2), least((SELECT max(i) FROM rings WHERE st >= 0.2), i)) AS s FROM rings)
SELECT d.field_id, d.i, d.j, """ + rnd("s.f", "f") + " FROM ec d JOIN src ON src.i = d.i JOIN ec s ON s.field_id = d.field_id AND s.i = src.s AND s.j = d.j")
def _(spark, sf):
    """Event sums on 16 rings; the two polar rings copy their neighbours."""
    ev = B.table(spark, sf, "events")
    f = ev.groupBy(F.col("event_type").alias("field_id"), (F.col("user_id") % 16).cast("int").alias("i"), (F.col("event_id") % 8).cast("int").alias("j")).agg(F.sum("value").alias("f"))
    return fp.cap_row_fill(f, 16, ["f"])


@fitq("curve_overlay_points", "," + rings_cte(4, "cr") + f""", br AS (SELECT r.i AS r, r.theta, coalesce(greatest(0, least({NLAT - 2}, (SELECT max(f.i) FROM rings f WHERE f.theta <= r.theta))), 0) AS a FROM cr r),
bw AS (SELECT r, a, least(1.0, greatest(0.0, (br.theta-p.theta)/(s.theta-p.theta))) AS w FROM br JOIN rings p ON p.i = a JOIN rings s ON s.i = a+1),
mb AS (SELECT CAST(range AS INTEGER) AS m, CAST(floor(range*{NPHI}/6.0) AS INTEGER) % {NPHI} AS c0, range*{NPHI}/6.0 - floor(range*{NPHI}/6.0) AS w FROM range(6))
SELECT p.mesh_id, 'ring' AS kind, bw.r AS line, p.j AS pos, {', '.join(rnd(f'(1-w)*p.{k}+w*s.{k}', k) for k in 'xyz')} FROM bw JOIN grid p ON p.i = a JOIN grid s ON s.mesh_id = p.mesh_id AND s.i = a+1 AND s.j = p.j
UNION ALL SELECT p.mesh_id, 'meridian', mb.m, p.i, {', '.join(rnd(f'(1-w)*p.{k}+w*s.{k}', k) for k in 'xyz')} FROM mb JOIN grid p ON p.j = c0 JOIN grid s ON s.mesh_id = p.mesh_id AND s.j = (c0+1) % {NPHI} AND s.i = p.i""")
def _(spark, sf):
    return fp.curve_overlay_points(mesh_grid(spark, sf), 4, 6, NLAT, NPHI)


@q("pole_lookup", f" SELECT mesh_id, 0 AS q, {rs('x', 'y', 'z')} FROM verts WHERE v = {B.L_NLAT * B.L_NPHI}", corners=False)
def _(spark, sf):
    """The surface point of the chart's north pole, one query per mesh."""
    m = L(spark, sf)
    ask = m.chart.select("mesh_id").distinct().select("mesh_id", F.lit(0).alias("q"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    return su.resample(m.vertices, m.faces, m.chart, ask)
