import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orbtable.operators import rank


def skewed(spark, n=20000):
    """A third of the rows share one value, most rows one key."""
    rng = np.random.default_rng(1)
    v = np.where(rng.random(n) < 1 / 3, 0.25, np.round(rng.normal(size=n), 3))
    k = np.where(rng.random(n) < 0.8, "hot", "cold")
    return pd.DataFrame({"k": k, "v": v, "t": np.arange(n)})


def test_order_statistics_are_exact(spark):
    pdf = skewed(spark)
    got = rank.order_statistics(spark.createDataFrame(pdf), ["k"], "v",
                                {"a": ("floor", 0.99), "b": ("round", 0.02), "c": ("half", 0.5), "d": ("floor", 1.0)}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        s, n = np.sort(g["v"].to_numpy()), len(g)
        want = (s[int(np.floor(0.99 * (n - 1)))], s[int(np.floor(0.02 * (n - 1) + 0.5))], s[n // 2], s[-1])
        assert tuple(got.loc[k, list("abcd")]) == want and got.loc[k, "n"] == n


def test_number_by_value_with_ties(spark):
    pdf = skewed(spark)
    got = rank.number_by_value(spark.createDataFrame(pdf), ["k"], "v", "t", "r", buckets=16).toPandas()
    for k, g in got.groupby("k"):
        want = g.sort_values(["v", "t"])["r"].to_numpy()
        assert (want == np.arange(len(g))).all()


def test_number_by_ordinal_crosses_blocks(spark):
    df = spark.range(1000).select(F.lit("m").alias("k"), (F.col("id") * 7).alias("o"))
    got = rank.number_by_ordinal(df, ["k"], "o", "r", block=100).orderBy("o").toPandas()
    assert got["r"].tolist() == list(range(1000))


def test_lowest_and_highest_share(spark):
    pdf = skewed(spark, 500)
    df = spark.createDataFrame(pdf)
    got = rank.lowest_share(df, ["k"], "v", "t", F.floor(F.col("n") * 0.2), highest=True).toPandas()
    for k, g in pdf.groupby("k"):
        want = g.sort_values(["v", "t"], ascending=[False, True]).head(int(len(g) * 0.2))["t"]
        assert set(got[got["k"] == k]["t"]) == set(want)


def test_selection_over_all_magnitudes(spark):
    """Values of both signs and all exponents, zeros, infinities and long runs of one value; each pass narrows by bits."""
    rng = np.random.default_rng(9)
    wild = np.concatenate([rng.normal(size=4000) * 10.0 ** rng.integers(-300, 300, 4000), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324], np.full(3000, 7.25)])
    groups = {"wild": wild, "one": np.array([-2.5]), "geometric": 2.0 ** -np.arange(1000.0), "same": np.full(500, -1e-9), "large": rng.normal(size=60_000)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "v": rng.permutation(v)}) for g, v in groups.items()])).repartition(4)
    picks = {"low": ("floor", 0.01), "mid": ("half", 0.5), "near": ("round", 0.98), "first": ("floor", 0.0), "last": ("floor", 1.0)}
    got = {r["g"]: r for r in rank.order_statistics(df, ["g"], "v", picks).collect()}
    for g, v in groups.items():
        s, n = np.sort(v), len(v)
        want = [s[int(np.floor(0.01 * (n - 1)))], s[n // 2], s[int(np.floor(0.98 * (n - 1) + 0.5))], s[0], s[-1]]
        assert got[g]["n"] == n and [got[g][c] for c in picks] == want, g
