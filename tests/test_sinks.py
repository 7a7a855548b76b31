import os

import pytest
from pyspark.sql import functions as F

from orbtable.sources.sinks import read_coeffs, write_coeffs

KW = dict(lmax=3, nlat=8, nphi=16)


def _coeffs(spark, names, lmax=3):
    rows = [(n, c, l, m, float(l), float(m)) for n in names for c in "xy" for l in range(lmax + 1) for m in range(l + 1)]
    return spark.createDataFrame(rows, "field_id string, comp string, l int, m int, re double, im double")


def _names(spark, path):
    rows, provenance = read_coeffs(spark, path)
    assert rows.count() == 20 * provenance.count()
    return sorted(r["model"] for r in provenance.collect())


def test_writes_add_up_and_replace(spark, tmp_path):
    path = str(tmp_path / "store")
    write_coeffs(_coeffs(spark, ["a", "b"]), path, **KW)
    assert _names(spark, path) == ["a", "b"]
    with pytest.raises(ValueError):
        write_coeffs(_coeffs(spark, ["c"]), path, **KW)
    write_coeffs(_coeffs(spark, ["c"]), path, mode="append", **KW)
    assert _names(spark, path) == ["a", "b", "c"]
    write_coeffs(_coeffs(spark, ["d"]), path, mode="overwrite", **KW)
    assert _names(spark, path) == ["d"]


@pytest.mark.parametrize("fault", [
    lambda q: q.where("NOT (field_id = 'b' AND comp = 'y' AND l = 3 AND m = 3)"),   # the last row of all
    lambda q: q.where("NOT (field_id = 'a' AND comp = 'x' AND l = 0)"),             # the first
    lambda q: q.where("NOT (field_id = 'a' AND comp = 'y' AND l = 2 AND m = 1)"),
    lambda q: q.unionByName(q.where("field_id = 'a' AND l = 2 AND m = 1")),
    lambda q: q.withColumn("m", F.expr("CASE WHEN l = 1 AND m = 1 THEN 2 ELSE m END")),
    lambda q: q.withColumn("comp", F.expr("CASE WHEN l = 3 AND m = 3 THEN null ELSE comp END")),
])
def test_incomplete_components_leave_nothing_visible(spark, tmp_path, fault):
    path = str(tmp_path / "store")
    write_coeffs(_coeffs(spark, ["z"]), path, **KW)
    with pytest.raises(ValueError):
        write_coeffs(fault(_coeffs(spark, ["a", "b"])), path, mode="append", **KW)
    assert _names(spark, path) == ["z"]
    assert len(os.listdir(tmp_path / "store" / "data")) == 1


def test_an_empty_table_is_an_empty_write(spark, tmp_path):
    path = str(tmp_path / "store")
    write_coeffs(_coeffs(spark, []), path, **KW)
    assert _names(spark, path) == []
