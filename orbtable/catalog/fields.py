"""Spherical-harmonic queries on the event fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.catalog import register
from orbtable.catalog.sqlkit import (
    PI, TAU, basis_cte, event_samples_cte, event_spectrum, gains_cte, rings_cte, rnd, specs_cte, synth_cte, values,
)
from orbtable.functions import spectral as fs
from orbtable.functions.text import filter_label, format_value
from orbtable.operators import grids, rank, spectral as sp
from orbtable.session import settle
from orbtable.sources import generate, sinks

NLAT, NPHI, LMAX = B.E_NLAT, B.E_NPHI, B.E_LMAX
EV = event_spectrum()


def coeffs(spark, sf):
    return sp.sh_analysis(B.event_samples(spark, sf), NLAT, NPHI, LMAX)


def part_specs(spark: SparkSession, sf: str) -> DataFrame:
    """One filter spec per part: the sweep grows with the table.

    A small file of parts means many gains, so the specs are dealt to as many tasks as any shuffle.
    """
    p = B.table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    kinds = F.array(*[F.lit(k) for k in ("none", "hard", "fraction", "trapeziform", "gaussian")])
    return p.select(
        F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("spec_id"),
        kinds[(F.col("p_partkey") % 5).cast("int")].alias("kind"),
        (F.col("p_size") % 6).cast("double").alias("cutoff"),
        (F.col("p_size") % 3).cast("double").alias("ramp"),
        (0.2 + F.col("p_size") / 50.0).alias("sigma"),
        (1 + F.col("p_size") % 4).cast("double").alias("r"),
    )


# ---------------------------------------------------------------- transforms


@register("power_spectrum", EV + f"SELECT field_id, l, {rnd('p')} FROM power")
def _(spark, sf):
    return sp.power_spectrum(coeffs(spark, sf))


@register("sh_analysis", EV + f"SELECT field_id, comp, l, m, {rnd('re')}, {rnd('im')} FROM coeffs")
def _(spark, sf):
    return coeffs(spark, sf)


@register("dft_rings", EV + f"SELECT field_id, comp, i, m, {rnd('re')}, {rnd('im')} FROM coeffs_dft")
def _(spark, sf):
    return sp.dft_rings(B.event_samples(spark, sf), NPHI, LMAX)


@register("sh_legendre_synth", EV + "," + synth_cte("coeffs", NPHI, "back")
          + f" SELECT field_id, comp, i, m, {rnd('re')}, {rnd('im')} FROM back_fm")
def _(spark, sf):
    return sp.sh_legendre_synth(coeffs(spark, sf), NLAT, LMAX)


@register("sh_synthesis", EV + "," + synth_cte("coeffs", NPHI, "back")
          + f" SELECT field_id, comp, i, j, {rnd('f')} FROM back")
def _(spark, sf):
    return sp.sh_synthesis(coeffs(spark, sf), NLAT, NPHI, LMAX)


def _refine_sql() -> str:
    from orbtable.catalog.sqlkit import analysis_cte
    return (EV + "," + synth_cte("coeffs", NPHI, "back") + """,
resid AS (SELECT s.field_id, s.comp, s.i, s.j, s.f - b.f AS f FROM samples s JOIN back b
          ON s.field_id = b.field_id AND s.comp = b.comp AND s.i = b.i AND s.j = b.j),"""
            + analysis_cte("resid", NPHI, "corr") +
            f"""SELECT c.field_id, c.comp, c.l, c.m, {rnd('c.re + k.re', 're')}, {rnd('c.im + k.im', 'im')}
FROM coeffs c JOIN corr k ON c.field_id = k.field_id AND c.l = k.l AND c.m = k.m""")


@register("sh_refine", _refine_sql())
def _(spark, sf):
    return sp.sh_refine(B.event_samples(spark, sf), NLAT, NPHI, LMAX)


_UP = "(({l}) * sqrt(((({l})-m+1)*(({l})+m+1))/((2.0*({l})+1)*(2*({l})+3))))"
_DOWN = "(-(({l})+1) * sqrt(((({l})-m)*(({l})+m))/((2.0*({l})-1)*(2*({l})+1))))"
_NEIGH = f"""
nb AS (SELECT field_id, comp, l, m,
  coalesce(lag(re) OVER k, 0.0) AS re_below, coalesce(lag(im) OVER k, 0.0) AS im_below,
  coalesce(lead(re) OVER k, 0.0) AS re_above, coalesce(lead(im) OVER k, 0.0) AS im_above
  FROM coeffs WINDOW k AS (PARTITION BY field_id, comp, m ORDER BY l)),
dth AS (SELECT field_id, comp, l, m,
  CASE WHEN l > m THEN {_UP.format(l='l-1')} ELSE 0 END * re_below + {_DOWN.format(l='l+1')} * re_above AS re,
  CASE WHEN l > m THEN {_UP.format(l='l-1')} ELSE 0 END * im_below + {_DOWN.format(l='l+1')} * im_above AS im
  FROM nb)"""


@register("degree_neighbour", EV + "," + _NEIGH + f""" SELECT field_id, comp, l, m, {rnd('re_below')}, {rnd('im_below')},
  {rnd('re_above')}, {rnd('im_above')} FROM nb""")
def _(spark, sf):
    return sp.degree_neighbours(coeffs(spark, sf))


@register("alpha_plus_minus", EV + "," + _NEIGH + f" SELECT field_id, comp, l, m, {rnd('re')}, {rnd('im')} FROM dth")
def _(spark, sf):
    return sp.sin_dtheta_coeffs(coeffs(spark, sf))


@register("sh_sin_dtheta", EV + "," + _NEIGH + "," + synth_cte("dth", NPHI, "back")
          + f" SELECT field_id, comp, i, j, {rnd('f')} FROM back")
def _(spark, sf):
    return sp.sh_sin_dtheta(coeffs(spark, sf), NLAT, NPHI, LMAX)


@register("sh_dtheta", EV + "," + _NEIGH + "," + synth_cte("dth", NPHI, "back")
          + f" SELECT field_id, comp, back.i, j, {rnd('f / r.st', 'f')} FROM back JOIN rings r ON r.i = back.i")
def _(spark, sf):
    return sp.sh_dtheta(coeffs(spark, sf), NLAT, NPHI, LMAX)


@register("sh_dphi", EV + ", dph AS (SELECT field_id, comp, l, m, -m*im AS re, m*re AS im FROM coeffs),"
          + synth_cte("dph", NPHI, "back") + f" SELECT field_id, comp, i, j, {rnd('f')} FROM back")
def _(spark, sf):
    return sp.sh_dphi(coeffs(spark, sf), NLAT, NPHI, LMAX)


@register("fourier_dphi", EV + f""", modes AS (SELECT field_id, comp, i, m, -m*im/{TAU} AS re, m*re/{TAU} AS im FROM coeffs_dft)
SELECT field_id, comp, i, j, {rnd(f'sum(CASE WHEN m = 0 THEN re ELSE 2*(re*cos({TAU}*((m*j)%{NPHI})/{NPHI}) - im*sin({TAU}*((m*j)%{NPHI})/{NPHI})) END)', 'f')}
FROM modes, (SELECT CAST(range AS INTEGER) AS j FROM range({NPHI})) GROUP BY field_id, comp, i, j""")
def _(spark, sf):
    return sp.fourier_dphi(B.event_samples(spark, sf), NPHI, LMAX)


@register("basis_join", EV + f"""SELECT d.field_id, d.comp, b.l, d.i, d.m, {rnd('r.w*b.y*d.re', 're')}, {rnd('r.w*b.y*d.im', 'im')}
FROM coeffs_dft d JOIN rings r ON r.i = d.i JOIN bas b ON b.i = d.i AND b.m = d.m""")
def _(spark, sf):
    g = sp.dft_rings(B.event_samples(spark, sf), NPHI, LMAX)
    return sp.basis_join(g, NLAT, LMAX).select(
        "field_id", "comp", "l", "i", "m",
        (F.col("w") * F.col("y") * F.col("re")).alias("re"), (F.col("w") * F.col("y") * F.col("im")).alias("im"))


# ---------------------------------------------------------------- coefficient tables


@register("relayout", EV + f"""SELECT t.field_id, t.comp, t.l, t.m, {rnd('coalesce(c.re, 0.0)', 're')}, {rnd('coalesce(c.im, 0.0)', 'im')}
FROM (SELECT DISTINCT c.field_id, c.comp, CAST(a.range AS INTEGER) AS l, CAST(b.range AS INTEGER) AS m
      FROM coeffs c, range(9) a, range(9) b WHERE b.range <= a.range) t
LEFT JOIN coeffs c ON c.field_id = t.field_id AND c.comp = t.comp AND c.l = t.l AND c.m = t.m""")
def _(spark, sf):
    return sp.relayout(coeffs(spark, sf), 8)


@register("band_filter", EV + f"SELECT field_id, comp, l, m, {rnd('re')}, {rnd('im')} FROM coeffs WHERE l <= 3")
def _(spark, sf):
    return sp.band_filter(coeffs(spark, sf), 3)


@register("degree_gains", "WITH RECURSIVE" + specs_cte() + "," + gains_cte(LMAX) + f" SELECT spec_id, l, {rnd('g')} FROM gains")
def _(spark, sf):
    """Every gain kind: none, hard, fraction, trapeziform and gaussian."""
    return sp.gains_for(part_specs(spark, sf), LMAX)


@register("gain_join", EV + "," + specs_cte() + "," + gains_cte(LMAX) + f"""SELECT c.field_id, g.spec_id, c.comp, c.l, c.m,
  {rnd('c.re*g.g', 're')}, {rnd('c.im*g.g', 'im')} FROM coeffs c JOIN gains g ON g.l = c.l""")
def _(spark, sf):
    """Spectra are written first, so that the planner knows them to be few: a degree is no key to share work by."""
    return sp.apply_gains(settle(coeffs(spark, sf), "coeffs"), sp.gains_for(part_specs(spark, sf), LMAX))


@register("filter_report", EV + "," + specs_cte() + "," + gains_cte(LMAX) + f"""SELECT p.field_id, g.spec_id,
  {rnd(f'100*max(CASE WHEN g.l = {LMAX} THEN g.g END)', 'gain_lmax')},
  {rnd(f'100*sum((2*g.l+1)*g.g*g.g)/{(LMAX + 1) ** 2}', 'kept_pct')},
  {rnd('100*sum(g.g*g.g*p.p)/sum(p.p)', 'energy_pct')}
FROM power p JOIN gains g ON g.l = p.l GROUP BY 1, 2""")
def _(spark, sf):
    return sp.filter_report(sp.power_spectrum(coeffs(spark, sf)), sp.gains_for(part_specs(spark, sf), LMAX), LMAX)


@register("cum_degree_energy", EV + f"""SELECT field_id, l,
 {rnd('100*sum(p) OVER (PARTITION BY field_id ORDER BY l ROWS UNBOUNDED PRECEDING)/sum(p) OVER (PARTITION BY field_id)', 'energy_pct')}
FROM power""")
def _(spark, sf):
    return sp.cum_degree_energy(sp.power_spectrum(coeffs(spark, sf)))


@register("relative_spectrum", EV + f"""SELECT field_id, l, {rnd('p/max(p) OVER (PARTITION BY field_id)', 'rel')},
 {rnd('log10(greatest(p/max(p) OVER (PARTITION BY field_id), 1e-30))', 'log10_rel')} FROM power""")
def _(spark, sf):
    return sp.relative_spectrum(sp.power_spectrum(coeffs(spark, sf)))


@register("lm_index", EV + f"""SELECT field_id, l, m, CAST(m*{LMAX + 1} - (m*(m-1))//2 + l - m AS BIGINT) AS lm,
 CAST({fs.nlm(LMAX)} AS BIGINT) AS nlm FROM coeffs""", digits=None)
def _(spark, sf):
    return coeffs(spark, sf).select(
        "field_id", "l", "m", fs.lm_index(LMAX, F.col("l"), F.col("m")).alias("lm"),
        fs.nlm_expr(F.lit(LMAX), F.lit(LMAX)).alias("nlm"))


@register("sink_flat_layout", EV + f"""SELECT field_id, comp, pos, {rnd('x')} FROM (
 SELECT field_id, comp, CAST(2*(m*{LMAX + 1} - (m*(m-1))//2 + l - m) AS INTEGER) AS pos, re AS x FROM coeffs
 UNION ALL SELECT field_id, comp, CAST(2*(m*{LMAX + 1} - (m*(m-1))//2 + l - m) + 1 AS INTEGER), im FROM coeffs)""")
def _(spark, sf):
    """The flat array is compared element by element."""
    flat = sp.flat_layout(coeffs(spark, sf), LMAX)
    return flat.select("field_id", "comp", F.posexplode("q").alias("pos", "x"))


@register("sink_coeffs", EV + f"SELECT field_id, comp, l, m, {rnd('re')}, {rnd('im')}, {NLAT} AS nlat, {NPHI} AS nphi, 'off' AS filter FROM coeffs")
def _(spark, sf):
    """Written to Parquet with its provenance and read back."""
    from orbtable.session import scratch_path
    path = scratch_path(spark, "coeffs")
    sinks.write_coeffs(coeffs(spark, sf), path, lmax=LMAX, nlat=NLAT, nphi=NPHI, filter_text="off", source="events")
    rows, provenance = sinks.read_coeffs(spark, path)
    return rows.join(provenance, "model").select(
        "field_id", "comp", "l", "m", "re", "im", "nlat", "nphi", F.col("filter"))


# ---------------------------------------------------------------- parameter tables


@register("filter_label", "WITH" + specs_cte() + """ SELECT spec_id, CASE kind WHEN 'hard' THEN 'hard N=' || CAST(cutoff AS BIGINT)
 WHEN 'trapeziform' THEN 'trapeziform N=' || CAST(cutoff AS BIGINT) || ' ramp=' || CAST(ramp AS BIGINT)
 WHEN 'gaussian' THEN 'gaussian sigma=' || CAST(sigma AS VARCHAR) ELSE 'off' END AS label FROM specs""")
def _(spark, sf):
    return part_specs(spark, sf).select(
        "spec_id", filter_label(F.col("kind"), F.col("cutoff"), F.col("ramp"), F.col("sigma")).alias("label"))


@register("grid_sizes", """SELECT p_partkey, lmax, pdeg,
 CAST(2*ceil(greatest(lmax+1.0, ((pdeg+1)*lmax+1)/2.0)/2) AS BIGINT) AS nlat,
 (SELECT min(CAST(1 AS BIGINT) << CAST(range AS INTEGER)) FROM range(60) WHERE (CAST(1 AS BIGINT) << CAST(range AS INTEGER)) >= (pdeg+1)*lmax+1) AS nphi
FROM (SELECT p_partkey, CAST(p_size * CASE WHEN p_partkey % 50 = 0 THEN 1000003 ELSE 1 END AS BIGINT) AS lmax, CAST(1 + p_partkey % 7 AS BIGINT) AS pdeg FROM part)""")
def _(spark, sf):
    """Grid size per part: lmax from its size (some of many millions), product degree from its key."""
    cfg = B.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * F.when(F.col("p_partkey") % 50 == 0, 1000003).otherwise(1)).cast("bigint").alias("lmax"),
        (1 + F.col("p_partkey") % 7).cast("bigint").alias("pdeg"))
    return cfg.select("*", fs.grid_nlat(F.col("lmax"), F.col("pdeg")).alias("nlat"),
                      fs.grid_nphi(F.col("lmax"), F.col("pdeg")).alias("nphi"))


@register("validate_grid", """SELECT p_partkey, concat_ws('; ',
  CASE WHEN lmax < 1 THEN 'lmax below 1' END, CASE WHEN mmax NOT BETWEEN 0 AND lmax THEN 'mmax outside 0..lmax' END,
  CASE WHEN NOT nlat > lmax THEN 'nlat must exceed lmax' END,
  CASE WHEN nphi <= 2*mmax THEN 'nphi below 2*mmax+1' END) AS problems
FROM (SELECT p_partkey, CAST(p_size * (p_partkey % 4) AS INTEGER) AS lmax, CAST(p_size * (p_partkey % 4) + p_partkey % 5 - 3 AS INTEGER) AS mmax,
  CAST(p_size * (p_partkey % 4) + p_partkey % 7 - 2 AS INTEGER) AS nlat, CAST(2*p_size * (p_partkey % 4) + p_partkey % 9 - 4 AS INTEGER) AS nphi FROM part)""")
def _(spark, sf):
    """Grids of the parts: odd nlat (fine), lmax 0 and negative mmax (not) among them."""
    k, size = F.col("p_partkey"), F.col("p_size") * (F.col("p_partkey") % 4)
    cfg = B.table(spark, sf, "part").select(
        "p_partkey", size.cast("int").alias("lmax"), (size + k % 5 - 3).cast("int").alias("mmax"),
        (size + k % 7 - 2).cast("int").alias("nlat"), (2 * size + k % 9 - 4).cast("int").alias("nphi"))
    return cfg.select("p_partkey", grids.grid_problems().alias("problems"))


def _supplier_grids(spark, sf):
    return B.table(spark, sf, "supplier").select(
        "s_suppkey", (2 + F.col("s_suppkey") % 11).cast("int").alias("nlat"))


def _gauss_sql() -> str:
    import numpy as np
    rows = []
    for n in range(2, 13):
        x, w = np.polynomial.legendre.leggauss(n)
        rows += [(n, i, float(c), float(v)) for i, (c, v) in enumerate(zip(x[::-1], w[::-1]))]
    return "WITH " + values("g", "nlat, i, ct, w", rows) + f""" SELECT s_suppkey, CAST(g.nlat AS INTEGER) AS nlat, g.i,
 {rnd('acos(g.ct)', 'theta')}, {rnd('g.ct', 'ct')}, {rnd('sqrt(1-g.ct*g.ct)', 'st')}, {rnd('g.w', 'w')}
FROM supplier JOIN g ON g.nlat = 2 + s_suppkey % 11"""


@register("gauss_nodes", _gauss_sql())
def _(spark, sf):
    """Rings of every supplier's grid size; each distinct size is solved once."""
    cfg = _supplier_grids(spark, sf)
    return cfg.join(sp.rings_for(cfg), "nlat")


@register("legendre_basis", "WITH RECURSIVE " + rings_cte(NLAT) + "," + basis_cte(LMAX)
          + f", ecells AS (SELECT event_id, CAST(user_id % {NLAT} AS INTEGER) AS i FROM events) "
          + f"SELECT event_id, b.l, b.m, {rnd('b.y', 'y')} FROM ecells e JOIN bas b ON b.i = e.i")
def _(spark, sf):
    """Basis values at the ring of every event."""
    ev = B.event_cells(spark, sf).select("event_id", "i")
    return ev.join(sp.basis(spark, NLAT, LMAX), "i").select("event_id", "l", "m", "y")


@register("auto_oversample", f"""SELECT p_partkey, CASE WHEN pl THEN 4 WHEN rough > 0.25 THEN 3 ELSE 2 END AS analysis,
  CASE WHEN lmax+1 >= 512 THEN 1 WHEN 2*(lmax+1) >= 512 THEN 2 WHEN 4*(lmax+1) >= 512 THEN 4 ELSE 8 END AS display
FROM (SELECT p_partkey, p_size*12 AS lmax, p_partkey % 3 = 0 AS pl, p_retailprice/2000.0 - 0.22 AS rough FROM part)""")
def _(spark, sf):
    p = B.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 12).alias("lmax"), (F.col("p_partkey") % 3 == 0).alias("pl"),
        (F.col("p_retailprice") / 2000.0 - 0.22).alias("rough"))
    return p.select("p_partkey", grids.analysis_oversample(F.col("pl"), F.col("rough")).alias("analysis"),
                    grids.display_oversample(F.col("lmax")).alias("display"))


# ---------------------------------------------------------------- statistics of fields

_RANGES = """
fin AS (SELECT field_id, value FROM ecells WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)),
rk AS (SELECT field_id, value, row_number() OVER (PARTITION BY field_id ORDER BY value) - 1 AS k,
       count(*) OVER (PARTITION BY field_id) AS n FROM fin),
q AS (SELECT field_id, n, max(CASE WHEN k = floor(0.02*(n-1)+0.5) THEN value END) AS lo,
      max(CASE WHEN k = floor(0.98*(n-1)+0.5) THEN value END) AS hi FROM rk GROUP BY 1, 2)"""


@register("robust_range", "WITH" + event_samples_cte() + "," + _RANGES + f"""
SELECT field_id, {rnd('CASE WHEN hi-lo >= s THEN lo ELSE (lo+hi)/2 - s/2 END', 'lo')},
       {rnd('CASE WHEN hi-lo >= s THEN hi ELSE (lo+hi)/2 + s/2 END', 'hi')}
FROM (SELECT *, greatest(1e-9, 0.01*greatest(abs(lo), abs(hi))) AS s FROM q)""")
def _(spark, sf):
    return grids.robust_range(B.event_cells(spark, sf).select("field_id", "value"), ["field_id"], "value")


@register("finite_only", "WITH" + event_samples_cte() + f""" SELECT field_id, count(*) AS n, {rnd('avg(ratio)', 'mean')}
FROM (SELECT field_id, CASE WHEN i = 0 THEN CASE WHEN j = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE value/i END AS ratio FROM ecells)
WHERE NOT isnan(ratio) AND NOT isinf(ratio) GROUP BY 1""")
def _(spark, sf):
    """Ratios with infinities and NaNs, dropped before the statistics."""
    i, j = F.col("i"), F.col("j")
    bad = F.when(j == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    r = B.event_cells(spark, sf).select("field_id", F.when(i == 0, bad).otherwise(F.col("value") / F.when(i == 0, 1).otherwise(i)).alias("ratio"))
    return grids.finite_only(r, "ratio").groupBy("field_id").agg(F.count("*").alias("n"), F.avg("ratio").alias("mean"))


@register("index_quantile", "WITH" + event_samples_cte() + "," + _RANGES + f"""
SELECT field_id, n, {rnd('max(CASE WHEN k = floor(0.99*(n-1)) THEN value END)', 'p99')},
  {rnd('max(CASE WHEN k = n//2 THEN value END)', 'med')}, {rnd('max(CASE WHEN k = floor(0.02*(n-1)+0.5) THEN value END)', 'p02')}
FROM rk GROUP BY field_id, n""")
def _(spark, sf):
    return rank.order_statistics(
        B.event_cells(spark, sf), ["field_id"], "value",
        {"p99": ("floor", 0.99), "med": ("half", 0.5), "p02": ("round", 0.02)})


@register("ring_mean", "WITH" + event_samples_cte() + f""", v AS (SELECT field_id, i, CASE WHEN f = 0 THEN NULL ELSE f END AS f FROM samples)
SELECT field_id, CASE WHEN i = 0 THEN 'start' ELSE 'end' END AS cap, {rnd('avg(f)', 'f')} FROM v WHERE i IN (0, {NLAT - 1}) GROUP BY field_id, i""")
def _(spark, sf):
    """Empty cells are missing values here, stored as NaN."""
    s = B.event_samples(spark, sf).withColumn("f", F.when(F.col("f") == 0, float("nan")).otherwise(F.col("f")))
    return grids.ring_mean(s, NLAT).drop("comp")


@register("fmt_value", """SELECT p_partkey, CASE WHEN e = 2 THEN CAST(m AS VARCHAR)
  WHEN e = 1 THEN regexp_replace(substr(CAST(m AS VARCHAR),1,2) || '.' || substr(CAST(m AS VARCHAR),3,1), '\\.?0+$', '')
  WHEN e = 0 THEN regexp_replace(substr(CAST(m AS VARCHAR),1,1) || '.' || substr(CAST(m AS VARCHAR),2,2), '\\.?0+$', '')
  ELSE regexp_replace('0.' || repeat('0', CAST(-e-1 AS INTEGER)) || CAST(m AS VARCHAR), '\\.?0+$', '') END AS label
FROM (SELECT p_partkey, CASE WHEN m0 >= 1000 THEN e0+1 ELSE e0 END AS e, CASE WHEN m0 >= 1000 THEN 100 ELSE CAST(m0 AS INTEGER) END AS m
 FROM (SELECT p_partkey, e0, floor(x/pow(10.0, e0-2) + 0.5) AS m0
  FROM (SELECT p_partkey, x, CAST(floor(log10(x)) AS INTEGER) AS e0
   FROM (SELECT p_partkey, p_retailprice / (1 + p_partkey % 7 * 37.3 + p_size * p_size * 0.71) AS x FROM part))))""")
def _(spark, sf):
    x = F.col("p_retailprice") / (1 + F.col("p_partkey") % 7 * 37.3 + F.col("p_size") * F.col("p_size") * 0.71)
    return B.table(spark, sf, "part").select("p_partkey", format_value(x).alias("label"))


@register("floor_range", f"""SELECT mid, {rnd('CASE WHEN hi-lo >= s THEN lo ELSE (lo+hi)/2 - s/2 END', 'lo')},
 {rnd('CASE WHEN hi-lo >= s THEN hi ELSE (lo+hi)/2 + s/2 END', 'hi')}
FROM (SELECT *, greatest(1e-9, 0.01*greatest(abs(lo), abs(hi))) AS s
      FROM (SELECT p_partkey AS mid, p_retailprice AS lo, p_retailprice + p_size * 0.4 AS hi FROM part))""")
def _(spark, sf):
    p = B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("mid"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size") * 0.4).alias("hi"))
    lo, hi = grids.floor_range(F.col("lo"), F.col("hi"))
    return p.select("mid", lo.alias("lo"), hi.alias("hi"))


@register("gen_random_spectrum")
def _(spark, sf):
    """One seeded spectrum per supplier; numbers come from a hash, so there is no SQL twin."""
    seeds = B.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("field_id"), F.col("s_suppkey").alias("seed"))
    return generate.random_spectrum(seeds, LMAX)
