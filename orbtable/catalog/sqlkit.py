"""SQL fragments shared by the oracle twins (DuckDB dialect)."""

from __future__ import annotations

import math
import re

import numpy as np

from orbtable import bindings as B

TAU = repr(2 * math.pi)
PI = repr(math.pi)


def values(name: str, cols: str, rows) -> str:
    body = ", ".join("(" + ", ".join(repr(x) if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


def rings_cte(nlat: int, name: str = "rings") -> str:
    x, w = np.polynomial.legendre.leggauss(nlat)
    rows = [(i, float(math.acos(c)), float(c), float(math.sqrt(1 - c * c)), float(v))
            for i, (c, v) in enumerate(zip(x[::-1], w[::-1]))]
    return values(name, "i, theta, ct, st, w", rows)


def basis_cte(lmax: int, mmax: int | None = None, rings: str = "rings", name: str = "bas") -> str:
    """Recursive CTE of normalised Legendre values; needs WITH RECURSIVE."""
    mmax = lmax if mmax is None else mmax
    seeds = []
    for m in range(mmax + 1):
        prod = 1.0
        for k in range(1, m + 1):
            prod *= (2 * k + 1) / (2 * k)
        seeds.append((m, (-1.0) ** m * math.sqrt(prod / (4 * math.pi))))
    return (
        values(f"{name}_seed", "m, amm", seeds) + f""",
{name}_rec(i, ct, l, m, y, yp) AS (
  SELECT i, ct, m, m, amm * pow(st, m), CAST(0 AS DOUBLE) FROM {rings}, {name}_seed
  UNION ALL
  SELECT i, ct, l + 1, m,
    sqrt((2.0*l+3)*(2*l+1)/((l+1+m)*(l+1-m))) * ct * y
      - CASE WHEN l = m THEN 0 ELSE sqrt((2.0*l+3)/(2*l-1)*((l+m)*(l-m))/((l+1+m)*(l+1-m))) * yp END, y
  FROM {name}_rec WHERE l < {lmax}),
{name} AS (SELECT i, l, m, y FROM {name}_rec)"""
    )


def event_samples_cte() -> str:
    n, p = B.E_NLAT, B.E_NPHI
    return f"""
ecells AS (
  SELECT event_type AS field_id, CAST(user_id % {n} AS INTEGER) AS i,
         CAST((CAST(extract('hour' FROM ts)*3600 + extract('minute' FROM ts)*60 + floor(extract('second' FROM ts)) AS BIGINT)*{p}) // 86400 AS INTEGER) AS j,
         value FROM events),
samples AS (
  SELECT g.field_id, 'v' AS comp, g.i, g.j, coalesce(c.f, 0.0) AS f
  FROM (SELECT field_id, CAST(r.range AS INTEGER) AS i, CAST(s.range AS INTEGER) AS j
        FROM (SELECT DISTINCT field_id FROM ecells), range({n}) r, range({p}) s) g
  LEFT JOIN (SELECT field_id, i, j, avg(value) AS f FROM ecells GROUP BY 1,2,3) c USING (field_id, i, j))"""


def analysis_cte(samples: str, nphi: int, out: str = "coeffs", rings: str = "rings", bas: str = "bas",
                 mmax: int = B.E_LMAX) -> str:
    return f"""
{out}_dft AS (
  SELECT field_id, comp, i, m, {TAU}/{nphi} * sum(f*cos({TAU}*((m*j)%{nphi})/{nphi})) AS re,
         -{TAU}/{nphi} * sum(f*sin({TAU}*((m*j)%{nphi})/{nphi})) AS im
  FROM {samples}, (SELECT CAST(range AS INTEGER) AS m FROM range({mmax + 1})) GROUP BY ALL),
{out} AS (
  SELECT d.field_id, d.comp, b.l, b.m, sum(r.w*b.y*d.re) AS re,
         CASE WHEN b.m = 0 THEN 0.0 ELSE sum(r.w*b.y*d.im) END AS im
  FROM {out}_dft d JOIN {rings} r ON d.i = r.i JOIN {bas} b ON b.i = d.i AND b.m = d.m
  GROUP BY d.field_id, d.comp, b.l, b.m)"""


def synth_cte(coeffs: str, nphi: int, out: str, bas: str = "bas", keys: str = "field_id, comp") -> str:
    k = ", ".join("c." + s.strip() for s in keys.split(","))
    return f"""
{out}_fm AS (
  SELECT {k}, b.i, b.m, sum(c.re*b.y) AS re, sum(c.im*b.y) AS im
  FROM {coeffs} c JOIN {bas} b ON c.l = b.l AND c.m = b.m GROUP BY {k}, b.i, b.m),
{out} AS (
  SELECT {keys}, i, j, sum(CASE WHEN m = 0 THEN re ELSE
     2*(re*cos({TAU}*((m*j)%{nphi})/{nphi}) - im*sin({TAU}*((m*j)%{nphi})/{nphi})) END) AS f
  FROM {out}_fm, (SELECT CAST(range AS INTEGER) AS j FROM range({nphi})) GROUP BY {keys}, i, j)"""


def rnd(col: str, alias: str | None = None, digits: int = 6) -> str:
    return f"round({col}, {digits}) + 0.0 AS {alias or col}"


def event_spectrum() -> str:
    """WITH RECURSIVE prefix up to `coeffs` and `power` of the event fields."""
    return ("WITH RECURSIVE " + rings_cte(B.E_NLAT) + ",\n" + basis_cte(B.E_LMAX) + "," + event_samples_cte() + ","
            + analysis_cte("samples", B.E_NPHI) + """,
power AS (SELECT field_id, l, sum(CASE WHEN m = 0 THEN 1 ELSE 2 END * (re*re + im*im)) AS p FROM coeffs GROUP BY 1, 2)
""")


def specs_cte() -> str:
    """Filter specs of the part table (see fields.part_specs)."""
    return """
specs AS (
  SELECT 'k' || p_partkey AS spec_id,
         ['none', 'hard', 'fraction', 'trapeziform', 'gaussian'][1 + p_partkey % 5] AS kind,
         CAST(p_size % 6 AS DOUBLE) AS cutoff, CAST(p_size % 3 AS DOUBLE) AS ramp,
         0.2 + p_size / 50.0 AS sigma, CAST(1 + p_size % 4 AS DOUBLE) AS r FROM part)"""


def gains_cte(lmax: int) -> str:
    nq = max(4 * lmax, 200)
    x, w = np.polynomial.legendre.leggauss(nq)
    rows = [(k, float(c), float(v)) for k, (c, v) in enumerate(zip(x[::-1], w[::-1]))]
    return values("gq", "k, x, w", rows) + f""",
gp(k, x, w, l, p, pm) AS (
  SELECT k, x, w, 0, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM gq
  UNION ALL SELECT k, x, w, l+1, ((2*l+1)*x*p - l*pm)/(l+1), p FROM gp WHERE l < {lmax}),
gauss_raw AS (
  SELECT spec_id, l, sum(w*exp(-acos(x)*acos(x)/(2*sigma*sigma))*p) AS q
  FROM (SELECT spec_id, sigma FROM specs WHERE kind = 'gaussian'), gp GROUP BY 1, 2),
gains AS (
  SELECT spec_id, l, CASE kind WHEN 'hard' THEN CASE WHEN l <= cutoff THEN 1.0 ELSE 0.0 END
     WHEN 'fraction' THEN CASE WHEN l <= greatest(0, floor({lmax + 1}/sqrt(r) + 0.5) - 1) THEN 1.0 ELSE 0.0 END
     WHEN 'trapeziform' THEN least(1.0, greatest(0.0, (cutoff + greatest(1.0, ramp) - l)/greatest(1.0, ramp)))
     ELSE 1.0 END AS g
  FROM specs, (SELECT CAST(range AS INTEGER) AS l FROM range({lmax + 1})) WHERE kind <> 'gaussian'
  UNION ALL
  SELECT a.spec_id, a.l, a.q / z.q FROM gauss_raw a JOIN gauss_raw z ON a.spec_id = z.spec_id AND z.l = 0)"""


# ---------------------------------------------------------------- vectors as SQL text


def V(prefix: str) -> tuple[str, str, str]:
    return tuple(f"{prefix}{k}" for k in "xyz")


def ssub(p, q):
    return tuple(f"({a}-{b})" for a, b in zip(p, q))


def sadd(*vs):
    return tuple("(" + "+".join(c) + ")" for c in zip(*vs))


def sscale(p, k):
    return tuple(f"({a}*({k}))" for a in p)


def sdot(p, q):
    return "(" + "+".join(f"{a}*{b}" for a, b in zip(p, q)) + ")"


def scross(p, q):
    return (f"({p[1]}*{q[2]}-{p[2]}*{q[1]})", f"({p[2]}*{q[0]}-{p[0]}*{q[2]})", f"({p[0]}*{q[1]}-{p[1]}*{q[0]})")


def snorm(p):
    return f"sqrt({sdot(p, p)})"


def sarea(pre: str = "", names=("a", "b", "c")):
    a, b, c = (V(k + pre) for k in names)
    return f"(0.5*{snorm(scross(ssub(b, a), ssub(c, a)))})"


def svol(pre: str):
    a, b, c = (V(k + pre) for k in "abc")
    return sdot(a, scross(b, c))


def slen(p: str, q: str, pre: str = ""):
    return snorm(ssub(V(p + pre), V(q + pre)))


def sreg(pre: str = ""):
    e = [slen("b", "c", pre), slen("c", "a", pre), slen("a", "b", pre)]
    s = "(" + "+".join(e) + ")"
    return "(" + "+".join(f"abs({x}/{s}-1.0/3.0)" for x in e) + ")"


def sangle(p, q, r, pre: str = ""):
    u, w = ssub(V(q + pre), V(p + pre)), ssub(V(r + pre), V(p + pre))
    return f"acos(greatest(-1.0, least(1.0, {sdot(u, w)}/({snorm(u)}*{snorm(w)}))))"


def _corners_cte(name: str, verts: str, cols: list[str], faces: str = "faces") -> str:
    sel = ", ".join(f"{k}.{c} AS {k}{c}" for k in "abc" for c in cols)
    return (f"{name} AS (SELECT t.mesh_id, t.f, t.a, t.b, t.c, {sel} FROM {faces} t "
            + " ".join(f"JOIN {verts} {k} ON {k}.mesh_id = t.mesh_id AND {k}.v = t.{k}" for k in "abc") + ")")


def mesh_ctes(corners: bool = True) -> str:
    """verts (x.. surface, s.. exact chart, t.. warped chart), faces and their corners `fc`."""
    n, p, w = B.L_NLAT, B.L_NPHI, repr(B.L_WARP)
    nv = n * p
    body = 2 * (n - 1) * p
    out = f"""
cells AS (
  SELECT l_suppkey AS sk, CAST(l_partkey % {n} AS BIGINT) AS i, CAST(l_orderkey % {p} AS BIGINT) AS j,
    CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/count(*)/100 AS d,
    CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS DOUBLE)/count(*)/100 AS t
  FROM lineitem GROUP BY 1, 2, 3),
ids AS (SELECT DISTINCT sk FROM cells),
vgrid AS (
  SELECT sk, range AS v, CASE WHEN range < {nv} THEN range // {p} WHEN range = {nv} THEN -1 ELSE {n} END AS i,
    CASE WHEN range < {nv} THEN range % {p} ELSE 0 END AS j FROM ids, range({nv + 2})),
vang AS (
  SELECT g.sk, g.v, g.i, g.j, {PI}*(g.i+1)/{n + 1} AS th, {TAU}*g.j/{p} AS ph, 1 + 2*coalesce(c.d, 0.0) AS r,
    CASE WHEN g.v < {nv} THEN (coalesce(c.t, 0.04)-0.04)/0.04 ELSE 0 END AS st_,
    CASE WHEN g.v < {nv} THEN (coalesce(c.d, 0.05)-0.05)/0.05 ELSE 0 END AS sd_
  FROM vgrid g LEFT JOIN cells c ON c.sk = g.sk AND c.i = g.i AND c.j = g.j),
vang2 AS (SELECT *, th + {w}*{PI}/{n + 1}*st_ AS tw, ph + {w}*{TAU}/{p}*sd_ AS pw FROM vang),
verts AS (
  SELECT 's' || sk AS mesh_id, v, i, j, r*sin(th)*cos(ph) AS x, r*sin(th)*sin(ph) AS y, r*cos(th) AS z,
    sin(th)*cos(ph) AS sx, sin(th)*sin(ph) AS sy, cos(th) AS sz,
    sin(tw)*cos(pw) AS tx, sin(tw)*sin(pw) AS ty, cos(tw) AS tz FROM vang2),
fnum AS (
  SELECT sk, range AS f, CASE WHEN range < {body} THEN range // 2 ELSE (range - {body}) // 2 END AS cell
  FROM ids, range({2 * nv})),
fij AS (SELECT *, cell // {p} AS i, cell % {p} AS j, (cell % {p} + 1) % {p} AS j2 FROM fnum),
faces AS (
  SELECT 's' || sk AS mesh_id, f,
    CASE WHEN f < {body} THEN CASE WHEN f % 2 = 0 THEN i*{p}+j ELSE i*{p}+j2 END
         WHEN f % 2 = 0 THEN {nv} ELSE {(n - 1) * p}+j END AS a,
    CASE WHEN f < {body} THEN (i+1)*{p}+j WHEN f % 2 = 0 THEN j ELSE {nv + 1} END AS b,
    CASE WHEN f < {body} THEN CASE WHEN f % 2 = 0 THEN i*{p}+j2 ELSE (i+1)*{p}+j2 END
         WHEN f % 2 = 0 THEN j2 ELSE {(n - 1) * p}+j2 END AS c
  FROM fij)"""
    if corners:
        out += ",\n" + _corners_cte("fc", "verts", [*V(""), *V("s"), *V("t")])
    return out


def mesh_sql(tail: str, corners: bool = True, recursive: bool = False) -> str:
    text = ("WITH RECURSIVE" if recursive else "WITH") + mesh_ctes(corners) + tail
    return re.sub(r"\bby\b", '"by"', text)  # the y of corner b; the keyword is written in capitals


HALF = """
he AS (SELECT mesh_id, f, 0 AS k, a AS u, b AS w, c AS opp FROM faces UNION ALL
       SELECT mesh_id, f, 1, b, c, a FROM faces UNION ALL SELECT mesh_id, f, 2, c, a, b FROM faces),
edges AS (SELECT mesh_id, least(u,w) AS lo, greatest(u,w) AS hi, count(*) AS n, min(opp) AS opp1, max(opp) AS opp2,
          min(3*f+k) AS ord, min(f) AS f1, max(f) AS f2 FROM he GROUP BY 1, 2, 3)"""
ADJ = HALF + """,
adj AS (SELECT mesh_id, lo AS v, hi AS u FROM edges UNION ALL SELECT mesh_id, hi, lo FROM edges)"""
CORN = "(SELECT *, unnest([a, b, c]) AS v FROM {t})"
