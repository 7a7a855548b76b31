"""A spread of registered queries against DuckDB at the smallest scale (tools/check.py runs all of them)."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

TABLES = "supplier part lineitem events embeddings customer nation region".split()
NAMES = ["power_spectrum", "filter_report", "edges", "weld", "fold_count", "chart_roughness", "cot_laplacian", "knn_rank",
         "self_intersections", "loop_subdivide", "index_quantile", "src_ply", "stream_latest_wins", "running_best"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda df: df[cols].sort_values([c for c in cols if df[c].dtype.kind != "f"] + [c for c in cols if df[c].dtype.kind == "f"]).reset_index(drop=True)
    g, w = order(got), order(want)
    assert len(g) == len(w) > 0
    for c in cols:
        if w[c].dtype.kind == "f":
            np.testing.assert_allclose(g[c].astype(float), w[c].astype(float), atol=2e-6, rtol=0)
        else:
            assert g[c].tolist() == w[c].tolist()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
