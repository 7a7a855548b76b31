"""Results that hang on the last bit of a double."""

import math

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orbtable.functions import libm

# (copy, supplier) of sf0.1 with faces as far out as each other but for rounding
TIED = [(36, 445), (9, 69), (26, 632), (35, 927)]


def test_innermost_faces_that_tie_but_for_rounding(spark, tmp_path):
    """Shifted copies of four suppliers, whose nearest faces the JVM's sines put in another order than the SQL."""
    con = duckdb.connect()
    pick = " OR ".join(f"(k = {k} AND l_suppkey = {s})" for k, s in TIED)
    con.sql(f"""COPY (SELECT l_orderkey + k*150001 AS l_orderkey, l_partkey + k*20003 AS l_partkey, l_suppkey + k*1000 AS l_suppkey, l_discount, l_tax
        FROM '/root/testdata/sf0.1/lineitem.parquet', (SELECT range AS k FROM range(60)) WHERE {pick}) TO '{tmp_path}/lineitem.parquet'""")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.sql(entry.oracle_sql()["top2_inner_triangle"]).df()
    got = entry.queries()["top2_inner_triangle"](spark, str(tmp_path)).toPandas()
    pairs = lambda df: sorted(zip(df.mesh_id, df.place, df.f))
    assert len(want) == 2 * len(TIED) and pairs(got) == pairs(want)


def test_sines_and_squares_are_those_of_the_c_library(spark):
    rows = spark.range(20_000).select((F.col("id") * 0.00137 - 9).alias("x")).unionByName(spark.createDataFrame([(None,), (float("inf"),)], "x double"))
    both = rows.select("x", libm.sin_cos(F.col("x")).alias("a"), libm.square(F.col("x")).alias("s")).toPandas()
    known = both[both.x.notna() & (both.x.abs() < math.inf)]
    assert len(known) == 20_000
    assert all((a["sin"], a["cos"], s) == (math.sin(x), math.cos(x), math.pow(x, 2.0)) for x, a, s in zip(known.x, known.a, known.s))
    assert both[~both.index.isin(known.index)].s.isna().all()
