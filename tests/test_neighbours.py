"""The tree of the neighbour search against brute force: dense spots, far outliers, shared coordinates, foreign queries."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orbtable.operators import neighbours as nb


def frame(spark, groups, name):
    rows = [pd.DataFrame({"grp": g, name: ids, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}) for g, (ids, p) in groups.items()]
    return spark.createDataFrame(pd.concat(rows)).repartition(3)


def brute(points, queries, k):
    out = {}
    for g, (qids, q) in queries.items():
        if g not in points:
            continue
        ids, p = points[g]
        for i, x in zip(qids, q):
            d = sum((p[:, c] - x[c]) ** 2 for c in range(3))
            order = np.lexsort((ids, d))[:k]
            out[g, int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def searched(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault((r["grp"], r["qid"]), []).append((r["id"], r["d2"]))
    return out


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nb, "LEAF", 16)
    monkeypatch.setattr(nb, "TOGETHER", 20)
    rng = np.random.default_rng(4)
    dense = np.vstack([1e-7 * rng.normal(size=(200, 3)), [[1e6, 0, 0], [1e6, 1, 0], [-3e5, 2e5, 1]]])  # a spot and far outliers
    column = np.column_stack([np.where(rng.random(150) < 0.6, 1.0, rng.random(150)), rng.integers(0, 4, 150), rng.integers(0, 4, 150)])  # ties, copies
    even = rng.random((180, 3))
    few = rng.random((3, 3))
    groups = {"dense": dense, "column": column.astype(float), "even": even, "few": few}
    points = {g: (rng.permutation(1000)[:len(p)].astype(np.int64), p) for g, p in groups.items()}
    asked = {g: (np.arange(40, dtype=np.int64), np.vstack([p[:3], rng.normal(size=(37, 3)) * 3])) for g, p in groups.items()}
    asked["none"] = (np.arange(2, dtype=np.int64), rng.random((2, 3)))
    for k in (1, 5):
        assert searched(nb.knn_search(frame(spark, points, "id"), frame(spark, asked, "qid"), k)) == brute(points, asked, k)
    own = {g: v for g, v in points.items() if g in ("dense", "column")}
    assert searched(nb.knn_search(frame(spark, own, "id"), None, 6)) == brute(own, own, 6)


def test_tree_follows_the_data(spark, monkeypatch):
    """Leaves are small wherever the points are, at any depth, and every point is in one leaf."""
    monkeypatch.setattr(nb, "LEAF", 8)
    p = np.concatenate([2.0 ** -np.arange(60.0), [5.0]])  # each half as near to 0 as the one before
    df = spark.createDataFrame([("g", i, float(x), 0.0, 0.0) for i, x in enumerate(p)], "grp string, id long, x double, y double, z double")
    placed, nodes, depth = nb.build_tree(df)
    assert placed.count() == placed.select("id").distinct().count() == len(p)
    assert placed.groupBy("grp", "node").count().agg(F.max("count")).first()[0] <= 8 and depth >= 1
    assert nodes.where("leaf").agg(F.sum("n")).first()[0] == len(p)


def test_no_rows_and_no_finite_rows(spark):
    df = spark.createDataFrame([("g", 1, 0.0, 0.0, 0.0), ("g", 2, float("nan"), 0.0, 0.0), ("g", 3, None, 1.0, 0.0), ("g", 4, 1.0, float("inf"), 0.0)], "grp string, id long, x double, y double, z double")
    got = nb.knn_search(df, df.withColumnRenamed("id", "qid"), 3).collect()
    assert [tuple(r) for r in got] == [("g", 1, 1, 1, 0.0)]
    assert nb.knn_search(df.limit(0), df.withColumnRenamed("id", "qid").limit(0), 3).count() == 0
