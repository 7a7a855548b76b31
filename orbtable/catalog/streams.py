"""Streaming jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbtable.catalog import register
from orbtable.catalog.fields import EV, LMAX, NLAT, NPHI, coeffs, part_specs
from orbtable.catalog.sqlkit import TAU, event_spectrum, gains_cte, rnd, specs_cte
from orbtable.operators import spectral as sp
from orbtable.streaming import jobs



def _ts():
    return F.col("ts").cast("timestamp")


@register("stream_latest_wins", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS last_ts FROM events GROUP BY 1", digits=None)
def _(spark, sf):
    """The newest event of every user is its standing request."""
    ev = jobs.table_stream(spark, sf, "events")
    req = ev.select("user_id", "ts", "event_id", F.col("event_type").alias("kind"), F.col("ts").alias("last_ts"))
    return jobs.latest_wins(req, "user_id", ["ts", "event_id"], ["kind", "last_ts"])


@register("stream_stale_drop", """WITH cur AS (SELECT c_custkey AS user_id, c_custkey % 5 AS current FROM customer)
SELECT event_id, e.user_id, event_id % 6 AS generation FROM events e JOIN cur ON cur.user_id = e.user_id WHERE event_id % 6 >= current""")
def _(spark, sf):
    """Every event is a result of some generation; the customers stream in with the current one."""
    ev = jobs.table_stream(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 6).alias("generation"))
    cur = jobs.table_stream(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 5).alias("current"))
    return jobs.stale_drop(ev, cur, "user_id", "generation").select("event_id", "user_id", "generation")


@register("stream_filter_apply", EV + "," + specs_cte() + "," + gains_cte(LMAX) + f"""SELECT p.field_id, g.spec_id,
  {rnd(f'100*max(CASE WHEN g.l = {LMAX} THEN g.g END)', 'gain_lmax')}, {rnd(f'100*sum((2*g.l+1)*g.g*g.g)/{(LMAX + 1) ** 2}', 'kept_pct')},
  {rnd('100*sum(g.g*g.g*p.p)/sum(p.p)', 'energy_pct')} FROM power p JOIN gains g ON g.l = p.l GROUP BY 1, 2""")
def _(spark, sf):
    """The parts arrive as filter specs and meet the event spectra."""
    power = sp.power_spectrum(coeffs(spark, sf))
    kinds = F.array(*[F.lit(k) for k in ("none", "hard", "fraction", "trapeziform", "gaussian")])
    k, size = F.col("p_partkey"), F.col("p_size")
    specs = jobs.table_stream(spark, sf, "part").select(
        F.concat(F.lit("k"), k.cast("string")).alias("spec_id"), kinds[(k % 5).cast("int")].alias("kind"), (size % 6).cast("double").alias("cutoff"),
        (size % 3).cast("double").alias("ramp"), (0.2 + size / 50.0).alias("sigma"), (1 + size % 4).cast("double").alias("r"))
    return jobs.filter_apply(specs, power, LMAX)


def _stream_sql() -> str:
    return event_spectrum() + f""", sc AS (SELECT strftime(ts, '%Y-%m-%d') AS window_day, event_type, CAST(user_id % {NLAT} AS INTEGER) AS i,
 CAST((CAST(extract('hour' FROM ts)*3600 + extract('minute' FROM ts)*60 + floor(extract('second' FROM ts)) AS BIGINT)*{NPHI}) // 86400 AS INTEGER) AS j, value FROM events
 WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
sg AS (SELECT window_day, event_type, i, m, {TAU}/{NPHI}*sum(value*cos({TAU}*((m*j)%{NPHI})/{NPHI})) AS re, -{TAU}/{NPHI}*sum(value*sin({TAU}*((m*j)%{NPHI})/{NPHI})) AS im
 FROM sc, (SELECT CAST(range AS INTEGER) AS m FROM range({LMAX + 1})) GROUP BY ALL),
sq AS (SELECT window_day, event_type, b.l, b.m, sum(r.w*b.y*re) AS re, CASE WHEN b.m = 0 THEN 0 ELSE sum(r.w*b.y*im) END AS im FROM sg JOIN rings r ON r.i = sg.i JOIN bas b ON b.i = sg.i AND b.m = sg.m GROUP BY 1, 2, 3, 4)
SELECT window_day, event_type, l, {rnd('sum(CASE WHEN m = 0 THEN 1 ELSE 2 END*(re*re+im*im))', 'p', 4)} FROM sq GROUP BY 1, 2, 3"""


@register("stream_spectrum", _stream_sql(), digits=4)
def _(spark, sf):
    """Daily spectra of the event stream, closed days only."""
    ev = jobs.table_stream(spark, sf, "events")
    sec = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    cells = ev.select(F.col("event_type").alias("field_id"), (F.col("user_id") % NLAT).cast("int").alias("i"),
                      F.floor(sec * NPHI / 86400).cast("int").alias("j"), "value", _ts().alias("ts"))
    return jobs.stream_spectrum(cells, NLAT, NPHI, LMAX)
