"""Iterative jobs on the supplier meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.catalog import register
from orbtable.catalog.meshes import L, _dens, _FOLD, _lap, _params, _REG, exact_frame, q, rs, warped_frame
from orbtable.catalog.sqlkit import ADJ, CORN, TAU, V, _corners_cte, rings_cte, rnd, sarea, scross, sdot, svol
from orbtable.functions.vec import vec
from orbtable.operators import chart as ch, faces as fo, iterate as it, matrices as mx, spectral as sp
from orbtable.operators.mesh import adjacency, face_corners
from orbtable.plans import fit as fp, policy
from orbtable.session import settle
from orbtable.sources import generate as gen


def _smooth_sql(rounds: int, alpha: float) -> str:
    out = "," + ADJ + ", c0 AS (SELECT mesh_id, v, tx AS sx, ty AS sy, tz AS sz FROM verts)"
    for r in range(rounds):
        out += f""", n{r} AS (SELECT a.mesh_id, a.v, count(*) AS n, sum(p.sx) AS mx, sum(p.sy) AS my, sum(p.sz) AS mz FROM adj a JOIN c{r} p ON p.mesh_id = a.mesh_id AND p.v = a.u GROUP BY 1, 2),
w{r} AS (SELECT mesh_id, v, {', '.join(f'{1 - alpha}*s{k} + {alpha}*m{k}/n AS s{k}' for k in 'xyz')} FROM c{r} JOIN n{r} USING (mesh_id, v)),
c{r + 1} AS (SELECT mesh_id, v, {', '.join(f's{k}/sqrt(sx*sx+sy*sy+sz*sz) AS s{k}' for k in 'xyz')} FROM w{r})"""
    return out + f" SELECT mesh_id, v, {rs('sx', 'sy', 'sz')} FROM c{rounds}"


@q("smooth_chart", _smooth_sql(2, 0.5), corners=False)
def _(spark, sf):
    m = L(spark, sf)
    return it.smooth_chart(m.faces, m.warped, 2)


def _repair_sql(passes: int) -> str:
    out = "," + ADJ + ", c0 AS (SELECT mesh_id, v, tx, ty, tz FROM verts)"
    for r in range(passes):
        out += f""", {_corners_cte(f'g{r}', f'c{r}', list(V('t')))},
v{r} AS (SELECT mesh_id, f, a, b, c, sign({svol('t')}) AS sg FROM g{r}), m{r} AS (SELECT mesh_id, CASE WHEN 2*count(*) FILTER (WHERE sg > 0) >= count(*) THEN 1 ELSE -1 END AS maj FROM v{r} GROUP BY 1),
b{r} AS (SELECT mesh_id, unnest([a, b, c]) AS v FROM v{r} JOIN m{r} USING (mesh_id) WHERE sg <> maj), t{r} AS (SELECT DISTINCT mesh_id, v FROM b{r}),
w{r} AS (SELECT DISTINCT mesh_id, v FROM (SELECT * FROM t{r} UNION ALL SELECT a.mesh_id, a.u FROM adj a JOIN t{r} t ON t.mesh_id = a.mesh_id AND t.v = a.v)),
n{r} AS (SELECT a.mesh_id, a.v, sum(p.tx) AS x, sum(p.ty) AS y, sum(p.tz) AS z FROM adj a JOIN w{r} w ON w.mesh_id = a.mesh_id AND w.v = a.v JOIN c{r} p ON p.mesh_id = a.mesh_id AND p.v = a.u GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.mesh_id, c.v, {', '.join(f'CASE WHEN n.v IS NULL THEN c.t{k} ELSE n.{k}/sqrt(n.x*n.x+n.y*n.y+n.z*n.z) END AS t{k}' for k in 'xyz')} FROM c{r} c LEFT JOIN n{r} n ON n.mesh_id = c.mesh_id AND n.v = c.v)"""
    return out + f" SELECT mesh_id, v, {', '.join(rnd(f't{k}', f's{k}') for k in 'xyz')} FROM c{passes}"


@q("repair_folds", _repair_sql(6), corners=False)
def _(spark, sf):
    """Passes until no fold is left; the SQL does six, of which those after the last fold change nothing."""
    m = L(spark, sf)
    return it.repair_folds(m.faces, m.warped)[0]


WARP_NLAT, WARP_NPHI, WARP_ROUNDS = 8, 16, 30


def _warp_sql(nlat: int, nphi: int, rounds: int) -> str:
    """All rounds unrolled; every point is tried against every face of its mesh, and the first face that holds it counts."""
    n, body = nlat * nphi, 2 * (nlat - 1) * nphi
    A, B_, C = V("as"), V("bs"), V("cs")
    vol = lambda p, q, r: sdot(p, scross(q, r))
    P = V("q.")
    out = f""", {_dens('s', 'd0')}, {rings_cte(nlat, 'wr')},
wi AS (SELECT range AS f, CASE WHEN range < {body} THEN range // 2 // {nphi} ELSE 0 END AS i, CASE WHEN range < {body} THEN range // 2 % {nphi} ELSE (range - {body}) % {nphi} END AS j FROM range({body + 2 * nphi})),
wj AS (SELECT *, (j + 1) % {nphi} AS k FROM wi),
wf AS MATERIALIZED (SELECT f, CASE WHEN f < {body} THEN i*{nphi} + CASE WHEN f % 2 = 0 THEN j ELSE k END WHEN f < {body + nphi} THEN {n} ELSE {(nlat - 1) * nphi} + j END AS a,
 CASE WHEN f < {body} THEN (i+1)*{nphi} + j WHEN f < {body + nphi} THEN j ELSE {n + 1} END AS b,
 CASE WHEN f < {body} THEN CASE WHEN f % 2 = 0 THEN i*{nphi} + k ELSE (i+1)*{nphi} + k END WHEN f < {body + nphi} THEN k ELSE {(nlat - 1) * nphi} + k END AS c FROM wj),
wh AS MATERIALIZED (SELECT a AS u, b AS w FROM wf UNION ALL SELECT b, c FROM wf UNION ALL SELECT c, a FROM wf),
wm AS (SELECT DISTINCT mesh_id FROM verts),
p0 AS MATERIALIZED (SELECT mesh_id, CAST(i*{nphi} + range AS BIGINT) AS v, st*cos({TAU}*range/{nphi}) AS x, st*sin({TAU}*range/{nphi}) AS y, ct AS z FROM wm, wr, range({nphi})
 UNION ALL SELECT mesh_id, {n}, 0.0, 0.0, 1.0 FROM wm UNION ALL SELECT mesh_id, {n + 1}, 0.0, 0.0, -1.0 FROM wm),
fd AS MATERIALIZED (SELECT fc.mesh_id, f, {', '.join(k + 's' + c for k in 'abc' for c in 'xyz')}, {vol(A, B_, C)} AS det, p.d AS da, q.d AS db, r.d AS dc FROM fc
 JOIN d0 p ON p.mesh_id = fc.mesh_id AND p.v = fc.a JOIN d0 q ON q.mesh_id = fc.mesh_id AND q.v = fc.b JOIN d0 r ON r.mesh_id = fc.mesh_id AND r.v = fc.c)"""
    for k in range(rounds):
        out += f""", c{k} AS MATERIALIZED (SELECT mesh_id, a, b, c, {sarea('', ('a', 'b', 'c'))} AS area FROM (SELECT a.mesh_id, wf.a, wf.b, wf.c, {', '.join(f'{s}.{t} AS {s}{t}' for s in 'abc' for t in 'xyz')}
 FROM wf JOIN p{k} a ON a.v = wf.a JOIN p{k} b ON b.mesh_id = a.mesh_id AND b.v = wf.b JOIN p{k} c ON c.mesh_id = a.mesh_id AND c.v = wf.c)),
t{k} AS (SELECT mesh_id, sum(area) AS tot FROM c{k} GROUP BY 1),
e{k} AS (SELECT mesh_id, v, (count(*)+1)/(sum(area)/max(tot)) AS d2 FROM (SELECT mesh_id, area, unnest([a, b, c]) AS v FROM c{k}) JOIN t{k} USING (mesh_id) GROUP BY 1, 2),
l{k} AS (SELECT mesh_id, v, arg_min((n0*da+n1*db+n2*dc)/(n0+n1+n2), f) AS d FROM (SELECT q.mesh_id, q.v, f, det, da, db, dc, {vol(P, B_, C)} AS n0, {vol(A, P, C)} AS n1, {vol(A, B_, P)} AS n2
 FROM fd JOIN p{k} q ON q.mesh_id = fd.mesh_id) WHERE abs(det) >= 1e-14 AND n0/det >= -1e-12 AND n1/det >= -1e-12 AND n2/det >= -1e-12 GROUP BY 1, 2),
r{k} AS MATERIALIZED (SELECT p.mesh_id, p.v, d/d2 AS r, x, y, z FROM p{k} p JOIN l{k} USING (mesh_id, v) JOIN e{k} USING (mesh_id, v)),
m{k} AS (SELECT mesh_id, u AS v, {', '.join(f'sum(r*{c})/sum(r) AS {c}' for c in 'xyz')} FROM wh JOIN r{k} ON r{k}.v = wh.w GROUP BY 1, 2),
p{k + 1} AS MATERIALIZED (SELECT mesh_id, v, {', '.join(f'{c}/sqrt(x*x+y*y+z*z) AS {c}' for c in 'xyz')} FROM m{k})"""
    return out + f" SELECT mesh_id, v, {rs('x', 'y', 'z')} FROM p{rounds}"


@q("adaptive_warp", _warp_sql(WARP_NLAT, WARP_NPHI, WARP_ROUNDS))
def _(spark, sf):
    """All thirty rounds on the fit grid."""
    m = L(spark, sf)
    cfg = m.chart.select("mesh_id").distinct().select("mesh_id", F.lit(WARP_NLAT).alias("nlat"), F.lit(WARP_NPHI).alias("nphi"))
    faces = settle(gen.tensor_faces(cfg), "tensor")
    dirs = settle(gen.tensor_vertices(cfg, sp.rings_for(cfg)), "dirs")
    return it.adaptive_warp(m.vertices, m.faces, m.chart, faces, dirs, WARP_ROUNDS)


def _pcg_sql(rounds: int) -> str:
    """Unrolled conjugate gradients on (mass + dt L) x = mass * x-coordinate."""
    out = "," + _lap("s", 4.0, 0.1) + """, dg AS (SELECT mesh_id, row AS v, val AS d FROM mat WHERE row = col),
ms AS (SELECT mesh_id, v, sum(m) AS m FROM (SELECT mesh_id, unnest([a, b, c]) AS v, ha/3 AS m FROM ln2) GROUP BY 1, 2),
k0 AS (SELECT mesh_id, v, m*verts.x AS b, d, 0.0::DOUBLE AS x, m*verts.x AS r, m*verts.x/d AS p FROM verts JOIN ms USING (mesh_id, v) JOIN dg USING (mesh_id, v))"""
    for i in range(rounds):
        out += f""", q{i} AS (SELECT m.mesh_id, m.row AS v, sum(m.val*k.p) AS q FROM mat m JOIN k{i} k ON k.mesh_id = m.mesh_id AND k.v = m.col GROUP BY 1, 2),
a{i} AS (SELECT mesh_id, sum(r*r/d) AS rz, CASE WHEN sum(p*q) > 1e-30 THEN sum(r*r/d)/sum(p*q) ELSE 0 END AS al FROM k{i} JOIN q{i} USING (mesh_id, v) GROUP BY 1),
u{i} AS (SELECT mesh_id, v, b, d, x + al*p AS x, r - al*q AS r, p, rz FROM k{i} JOIN q{i} USING (mesh_id, v) JOIN a{i} USING (mesh_id)),
b{i} AS (SELECT mesh_id, CASE WHEN max(rz) > 1e-30 THEN sum(r*r/d)/max(rz) ELSE 0 END AS be FROM u{i} GROUP BY 1),
k{i + 1} AS MATERIALIZED (SELECT mesh_id, v, b, d, x, r, r/d + be*p AS p FROM u{i} JOIN b{i} USING (mesh_id))"""
    return out + f""", fn AS (SELECT mesh_id, sqrt(sum(r*r))/sqrt(sum(b*b)) AS residual FROM k{rounds} GROUP BY 1)
SELECT mesh_id, v, 'x' AS comp, {rnd('x')}, {rnd('residual')} FROM k{rounds} JOIN fn USING (mesh_id)"""


@q("jacobi_pcg", _pcg_sql(30))
def _(spark, sf):
    """Rounds until every residual is below the tolerance; the SQL goes on to a fixed number."""
    m = L(spark, sf)
    fr = exact_frame(spark, sf)
    rhs = mx.lumped_mass(fr).join(m.vertices, ["mesh_id", "v"]).select("mesh_id", "v", (F.col("m") * F.col("x")).alias("x"))
    return it.jacobi_pcg(mx.mass_plus_laplacian(fr, 0.1), rhs, ["x"], 1e-10, 200)


_UNIFORM = """SELECT DISTINCT mesh_id, v, u, 1.0::DOUBLE AS w FROM (SELECT mesh_id, unnest([a, b, c, b, c, a]) AS v, unnest([b, c, a, a, b, c]) AS u FROM faces)"""


def _harmonic_sql(pins: str, rounds: int, weights: str = _UNIFORM) -> str:
    """CTEs up to hs(mesh_id, v, comp, x): unrolled conjugate gradients for the Laplacian of edge weights, with pn(mesh_id, v, comp, x) held."""
    out = f""", ad AS MATERIALIZED ({weights}),
pn AS MATERIALIZED ({pins}), hp AS (SELECT DISTINCT mesh_id, v FROM pn), cs AS (SELECT DISTINCT comp FROM pn),
dg AS (SELECT mesh_id, v, comp, d FROM (SELECT mesh_id, v, sum(w) AS d FROM ad a WHERE NOT EXISTS (SELECT 1 FROM hp WHERE hp.mesh_id = a.mesh_id AND hp.v = a.v) GROUP BY 1, 2), cs),
ps AS (SELECT a.mesh_id, a.v, comp, sum(a.w*h.x) AS b FROM ad a JOIN pn h ON h.mesh_id = a.mesh_id AND h.v = a.u GROUP BY 1, 2, 3),
k0 AS MATERIALIZED (SELECT mesh_id, v, comp, d, 0.0::DOUBLE AS x, coalesce(b, 0) AS r, coalesce(b, 0)/d AS p FROM dg LEFT JOIN ps USING (mesh_id, v, comp))"""
    for i in range(rounds):
        out += f""", n{i} AS (SELECT a.mesh_id, a.v, comp, sum(a.w*k.p) AS s FROM ad a JOIN k{i} k ON k.mesh_id = a.mesh_id AND k.v = a.u GROUP BY 1, 2, 3),
q{i} AS MATERIALIZED (SELECT k.*, d*p - coalesce(s, 0) AS q FROM k{i} k LEFT JOIN n{i} USING (mesh_id, v, comp)),
a{i} AS (SELECT mesh_id, comp, sum(r*r/d) AS rz, CASE WHEN sum(p*q) > 1e-30 THEN sum(r*r/d)/sum(p*q) ELSE 0 END AS al FROM q{i} GROUP BY 1, 2),
u{i} AS MATERIALIZED (SELECT mesh_id, v, comp, d, x + al*p AS x, r - al*q AS r, p, rz FROM q{i} JOIN a{i} USING (mesh_id, comp)),
b{i} AS (SELECT mesh_id, comp, CASE WHEN max(rz) > 1e-30 THEN sum(r*r/d)/max(rz) ELSE 0 END AS be FROM u{i} GROUP BY 1, 2),
k{i + 1} AS MATERIALIZED (SELECT mesh_id, v, comp, d, x, r, r/d + be*p AS p FROM u{i} JOIN b{i} USING (mesh_id, comp))"""
    return out + f", hs AS (SELECT mesh_id, v, comp, x FROM k{rounds} UNION ALL SELECT mesh_id, v, comp, x FROM pn)"


@q("dirichlet_solve", _harmonic_sql("SELECT mesh_id, v, 'x' AS comp, x FROM verts WHERE v % 5 = 0", 24) + f" SELECT mesh_id, v, {rnd('x')} FROM hs", corners=False)
def _(spark, sf):
    """x of every fifth vertex held, harmonic in between (uniform weights)."""
    m = L(spark, sf)
    fixed = m.vertices.where("v % 5 = 0").select("mesh_id", "v", "x")
    return it.dirichlet_solve(it._negated(mx.tutte_laplacian(m.faces)), m.vertices, fixed, ["x"])


def _big(spark, sf):
    return settle(fo.most_regular_triangle(exact_frame(spark, sf)), "puncture")


def _balance_sql(plane: str) -> str:
    """The sphere map of planar positions plane(mesh_id, v, x, y), both poles' triangles made alike; after _REG."""
    return f""", mid AS (SELECT mesh_id, avg(x) AS mu, avg(y) AS mw FROM {plane} GROUP BY 1),
cen AS (SELECT mesh_id, v, x-mu AS u, y-mw AS w FROM {plane} JOIN mid USING (mesh_id)),
ce AS (SELECT *, u/(u*u+w*w) AS iu, w/(u*u+w*w) AS iw FROM cen), {_corners_cte('pc', 'ce', ['u', 'w', 'iu', 'iw'])},
inn AS (SELECT mesh_id, f, row_number() OVER (PARTITION BY mesh_id ORDER BY {'+'.join(f'sqrt({k}u*{k}u+{k}w*{k}w)' for k in 'abc')}, f) AS k FROM pc),
ch AS (SELECT i.mesh_id, min(k) AS k FROM inn i JOIN mr USING (mesh_id) WHERE i.f <> mr.f AND k <= 2 GROUP BY 1),
no AS (SELECT pc.mesh_id, ({'+'.join(f'sqrt(({p}u-{r}u)*({p}u-{r}u)+({p}w-{r}w)*({p}w-{r}w))' for p, r in ('ab', 'bc', 'ca'))})/3 AS north FROM pc JOIN mr ON mr.mesh_id = pc.mesh_id AND mr.f = pc.f),
so AS (SELECT pc.mesh_id, ({'+'.join(f'sqrt(({p}iu-{r}iu)*({p}iu-{r}iu)+({p}iw-{r}iw)*({p}iw-{r}iw))' for p, r in ('ab', 'bc', 'ca'))})/3 AS south FROM ch JOIN inn ON inn.mesh_id = ch.mesh_id AND inn.k = ch.k JOIN pc ON pc.mesh_id = inn.mesh_id AND pc.f = inn.f),
sc AS (SELECT mesh_id, v, u*sqrt(north*south)/north AS u, w*sqrt(north*south)/north AS w FROM cen JOIN no USING (mesh_id) JOIN so USING (mesh_id))
SELECT mesh_id, v, {rnd('2*u/(1+u*u+w*w)', 'sx')}, {rnd('2*w/(1+u*u+w*w)', 'sy')}, {rnd('(u*u+w*w-1)/(1+u*u+w*w)', 'sz')} FROM sc"""


_TURNS = """SELECT mesh_id, v, comp, x FROM (SELECT mesh_id, unnest([a, b, c]) AS v, unnest([1.0, -0.5, -0.5]) AS px,
  unnest([0.0, sqrt(3.0)/2, -sqrt(3.0)/2]) AS py FROM mr JOIN faces USING (mesh_id, f)), LATERAL (SELECT unnest(['u', 'w']) AS comp, unnest([px, py]) AS x)"""


@q("tutte_map", "," + _REG + _harmonic_sql(_TURNS, 70) + ", pl AS (SELECT h.mesh_id, h.v, h.x, k.x AS y FROM hs h JOIN hs k ON k.mesh_id = h.mesh_id AND k.v = h.v AND h.comp = 'u' AND k.comp = 'w')" + _balance_sql("pl"))
def _(spark, sf):
    m = L(spark, sf)
    return it.tutte_map(m.vertices, m.faces, _big(spark, sf))


_CORNERED = """SELECT mesh_id, v, comp, x FROM (SELECT mesh_id, unnest([a, b, c]) AS v, unnest([0.0, 1.0, al]) AS px, unnest([0.0, 0.0, up]) AS py FROM (
  SELECT mesh_id, a, b, c, abs(px*qx+py*qy+pz*qz)/(px*px+py*py+pz*pz) AS al,
    sqrt(pow(py*qz-pz*qy, 2)+pow(pz*qx-px*qz, 2)+pow(px*qy-py*qx, 2))/(px*px+py*py+pz*pz) AS up
  FROM (SELECT fc.mesh_id, a, b, c, bx-ax AS px, by-ay AS py, bz-az AS pz, cx-ax AS qx, cy-ay AS qy, cz-az AS qz FROM fc JOIN mr ON mr.mesh_id = fc.mesh_id AND mr.f = fc.f))),
  LATERAL (SELECT unnest(['u', 'w']) AS comp, unnest([px, py]) AS x)"""


@q("harmonic_map", "," + _REG + "," + _lap("", 2.0, None) + _harmonic_sql(_CORNERED, 80, "SELECT mesh_id, row AS v, col AS u, val AS w FROM mat WHERE row <> col")
   + ", pl AS (SELECT h.mesh_id, h.v, h.x, k.x AS y FROM hs h JOIN hs k ON k.mesh_id = h.mesh_id AND k.v = h.v AND h.comp = 'u' AND k.comp = 'w')" + _balance_sql("pl"))
def _(spark, sf):
    m = L(spark, sf)
    return it.harmonic_map(m.vertices, m.faces, _big(spark, sf))


@register("qc_correct")
def _(spark, sf):
    m = L(spark, sf)
    return it.qc_correct(m.vertices, m.faces, m.chart)


@q("puncture_balance", "," + _REG + _balance_sql("verts"))
def _(spark, sf):
    """The x, y projection of every surface as the planar map."""
    m = L(spark, sf)
    plane = m.vertices.select("mesh_id", "v", F.col("x").alias("u"), F.col("y").alias("w"))
    return ch.puncture_balance(m.faces, plane, _big(spark, sf))


@register("density_equalise")
def _(spark, sf):
    """Two steps from the exact chart; the log is returned."""
    m = L(spark, sf)
    return it.density_equalise(m.vertices, m.faces, m.chart, max_steps=2)[1]


@register("map_policy")
def _(spark, sf):
    """Report of the automatic choice, with a tight crowding limit so that both branches run."""
    m = L(spark, sf)
    return policy.map_policy(m.vertices, m.faces, _params(spark, sf), max_ratio=20.0, max_steps=1)[1]


_LOG = """lg AS (SELECT 'p' || l_partkey % 50 AS mesh_id, CAST(l_suppkey AS INTEGER) AS step, avg(l_discount) + 0.31415926535/(1+l_suppkey) AS spread FROM lineitem GROUP BY l_partkey % 50, l_suppkey)"""


def _log(spark, sf, name):
    """A step log made of order lines: 50 runs, one step per supplier."""
    li = B.table(spark, sf, "lineitem")
    return li.groupBy(F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("mesh_id"), F.col("l_suppkey").cast("int").alias("step")).agg(
        F.avg("l_discount").alias("_d")).select("mesh_id", "step", (F.col("_d") + 0.31415926535 / (1 + F.col("step"))).alias(name))


@register("running_best", f"""WITH {_LOG}, b AS (SELECT *, min(spread) OVER (PARTITION BY mesh_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM lg)
SELECT mesh_id, step, {rnd('spread')}, {rnd('best')}, coalesce(best > 0.9*lag(best, 10) OVER (PARTITION BY mesh_id ORDER BY step), false) AS plateau FROM b""")
def _(spark, sf):
    return it.running_best(_log(spark, sf, "spread"), window=10)


@register("energy_plateau", f"""WITH {_LOG} SELECT mesh_id, step, {rnd('spread', 'energy')}, coalesce(lag(spread, 5) OVER (PARTITION BY mesh_id ORDER BY step) - spread < 0.05*abs(spread), false) AS plateau FROM lg""")
def _(spark, sf):
    return it.energy_plateau(_log(spark, sf, "energy"), 0.05, 5)
