"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable import session

#: White space that separates words: space and U+0009 to U+000D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """`session.settle` with compressed files: texts are most of what these operators write, and disk is their limit."""
    return session.settle(df, label, packed=True)


def body(text: str = "text") -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(text), F.lit(""))


def for_python(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, `more` and the text for a Python stage. The id goes as a string: pandas has no whole numbers
    beside nulls, and would round large ones."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), *more, body().alias("text"))


def from_python(df: DataFrame) -> DataFrame:
    """doc_id as a number again."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


#: Rows of a text handed to or from Python at a time.
BATCH = 1000


def settle_python(df: DataFrame, label: str) -> DataFrame:
    """`settle` for a Python stage over whole texts, in batches of BATCH rows at most: a batch is held by
    Spark outside its heap, by Arrow and by pandas at once."""
    with session.small_batches(df.sparkSession, BATCH):
        return settle(df, label)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def row_print() -> Column:
    """64-bit print of a row's text and doc_id; equal rows share it."""
    return F.xxhash64(body(), F.col("doc_id"))


def power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


#: A group is hot when it holds at least this share of the rows, so there are at most HOT_GROUPS of them.
HOT_GROUPS = 1000


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of `rows` with one row per group; `size` counts the group's rows in `rows`.

    Groups with more than a thousandth of all rows number at most HOT_GROUPS, so they may be broadcast; a
    join by key would bring each of them to one task. All others meet by a shuffle.
    """
    limit = max(1000, total // HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col(size) >= limit))
    cold = groups.where(F.col(size) < limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


def worker_memo(name: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    holder = sys.modules.setdefault("_task_memo", types.ModuleType("_task_memo"))
    return holder.__dict__.setdefault(name, {})


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components by fewer edges: a node is tied to its smallest neighbour, and its other
    smaller neighbours to that one, so nodes of one cluster share what ties its hubs."""
    e = settle(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges")
    tied = e.join(e.groupBy("hi").agg(F.min("lo").alias("low")), "hi")
    return tied.select(F.col("hi").alias("a"), F.col("low").alias("b")).union(tied.select("lo", "low"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of the undirected graph `edges` (a, b); component is the smallest node reachable.

    Two contractions thin the edges. Each round then takes the smallest label of the neighbours and
    the label of that label, so long chains shorten by doubling. Labels are written each round;
    only a count comes to the driver.
    """
    edges = _contracted(_contracted(edges.select("a", "b")))
    both = settle(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "label")
    for _ in range(rounds):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, label.node == near.a).select("node", F.least("component", "m").alias("c"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("up"))
        step = settle(step.join(jump, "c", "left").select("node", F.least("c", F.coalesce("up", "c")).alias("component"), "was"), "label")
        label = step.select("node", "component")
        if not step.where("component <> was").limit(1).count():
            return label
    raise RuntimeError(f"components not settled after {rounds} rounds")
