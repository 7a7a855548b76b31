"""Nearest neighbours by a space-partition tree whose leaves follow the data.

A full node is split eight ways at sampled quantiles of its widest side, and once at its middle, until a leaf
holds few positions; the tree is as deep as the data ask for. A query scans the leaf next to it
first, then only leaves whose box is nearer than what it has found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbtable.session import settle

#: Positions of a leaf at most, and queries that meet a leaf in one group.
LEAF, TOGETHER = 2048, 4096
_AXES = "xyz"


def build_tree(spots: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(spots with `node`, nodes, depth) for spots(grp, id, x, y, z, ..) of distinct positions.

    nodes(grp, node, n, leaf, lx, hx, ..) have the tight box of their positions. A node's name is its parent's
    and one more letter; the root's is empty. The middle of the widest side separates any two positions in the end,
    however many share a coordinate.
    """
    now, nodes, placed, depth = spots.withColumn("node", F.lit("")), None, None, 0
    while True:
        box = now.groupBy("grp", "node").agg(F.count("*").alias("n"), *[f(c).alias(p + c) for c in _AXES for f, p in ((F.min, "l"), (F.max, "h"))])
        box = settle(box.withColumn("leaf", F.col("n") <= LEAF), "nodes")
        nodes = box if nodes is None else nodes.unionByName(box)
        full = box.where("not leaf")
        if not full.limit(1).count():
            placed = now if placed is None else placed.unionByName(now)
            return placed, nodes, depth
        side = [F.col("h" + c) - F.col("l" + c) for c in _AXES]
        axis = F.when((side[0] >= side[1]) & (side[0] >= side[2]), 0).when(side[1] >= side[2], 1).otherwise(2)
        widest = full.select("grp", "node", axis.alias("axis"), *["l" + c for c in _AXES], *["h" + c for c in _AXES])
        met = now.join(widest, ["grp", "node"], "left").withColumn("value", F.get(F.array(*_AXES), F.col("axis")))
        middle = F.max(F.get(F.array(*["l" + c for c in _AXES]), F.col("axis")) / 2 + F.get(F.array(*["h" + c for c in _AXES]), F.col("axis")) / 2)
        eighths = F.array(*[F.lit(k / 8) for k in range(1, 8)])
        cuts = met.where("axis IS NOT NULL").groupBy("grp", "node").agg(
            F.max("axis").alias("axis"), F.concat(F.percentile_approx("value", eighths, F.lit(1000)), F.array(middle)).alias("cuts"))
        cuts = settle(cuts, "cuts")
        at = now.join(cuts, ["grp", "node"], "left").withColumn("value", F.get(F.array(*_AXES), F.col("axis")))
        child = F.substring(F.lit("012345678"), F.size(F.filter("cuts", lambda e: e < F.col("value"))) + 1, F.lit(1))
        split = settle(at.select(*spots.columns, F.when(F.col("axis").isNotNull(), F.concat("node", child)).alias("to"), "node"), "split")
        ready = split.where("to IS NULL").drop("to")
        placed = ready if placed is None else placed.unionByName(ready)
        now = split.where("to IS NOT NULL").drop("node").withColumnRenamed("to", "node")
        depth += 1


def _gaps() -> tuple[Column, Column]:
    """Squared distances from x, y, z to the nearest and the farthest point of a box."""
    near = far = F.lit(0.0)
    for c in _AXES:
        out = F.greatest(F.col("l" + c) - F.col(c), F.col(c) - F.col("h" + c), F.lit(0.0))
        most = F.greatest(F.abs(F.col(c) - F.col("l" + c)), F.abs(F.col(c) - F.col("h" + c)))
        near, far = near + out * out, far + most * most
    return near, far


def _walk(queries: DataFrame, nodes: DataFrame, depth: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of `queries` with the leaves they come to; `keep` chooses among the children met at each step (near, far, n)."""
    near, far = _gaps()
    at = lambda k: nodes.where(F.length("node") == k).withColumn("parent", F.substring("node", 1, max(0, k - 1)))
    boxes = [p + c for c in _AXES for p in "lh"]
    found = None
    now = queries
    for k in range(depth + 1):
        if k == 0:
            met = now.join(at(0).drop("parent"), "grp")
        else:
            met = now.withColumnRenamed("node", "parent").join(at(k), ["grp", "parent"]).drop("parent")
        met = keep(met.withColumn("near", near).withColumn("far", far)).drop("near", "far", "n", *boxes)
        ends = met.where("leaf").drop("leaf")
        found = ends if found is None else found.unionByName(ends)
        now = met.where("not leaf").drop("leaf")
    return found


def _scan(visits: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(grp, qid, id, d2): the k nearest of a leaf for each visit (grp, qid, x, y, z, node), ties by id.

    Visits of one leaf meet it in groups of about TOGETHER, each with a copy of the leaf.
    """
    count = visits.groupBy("grp", "node").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    dealt = visits.join(count, ["grp", "node"]).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
    copies = placed.join(count, ["grp", "node"]).select("grp", "node", "id", *_AXES, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def scan(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"grp": [], "qid": [], "id": [], "d2": []})
        p = p.sort_values("id")
        a, b, ids = q[list(_AXES)].to_numpy(), p[list(_AXES)].to_numpy(), p["id"].to_numpy()
        m, rows = min(k, len(b)), []
        for s in range(0, len(a), 512):
            d = sum((b[:, c] - a[s:s + 512, c, None]) ** 2 for c in range(3))
            if m < len(b):  # everything up to the m-th distance, so that ties go by id
                d[d > np.partition(d, m - 1, axis=1)[:, m - 1:m]] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :m]
            rows.append((np.repeat(q["qid"].to_numpy()[s:s + 512], m), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel()))
        qid, found, d2 = (np.concatenate(x) for x in zip(*rows))
        return pd.DataFrame({"grp": q["grp"].iloc[0], "qid": qid, "id": found, "d2": d2})

    key = ["grp", "node", "part"]
    return dealt.select(*key, "qid", *_AXES).groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(scan, "grp string, qid bigint, id bigint, d2 double")


def knn_search(points: DataFrame, queries: DataFrame | None, k: int) -> DataFrame:
    """The k nearest points of every query in its group, ties by smaller id.

    points(grp, id, x, y, z), queries(grp, qid, x, y, z) -> (grp, qid, rank, id, d2), rank from 1. Without
    queries the points ask themselves, each from its own leaf.

    Equal positions are merged first and keep their k smallest ids, which are the only ones that can be among k
    nearest, so copies never meet each other; equal queries are asked once. A row without finite coordinates is
    neither found nor asked. A group without points has no rows.
    """
    finite = lambda df: df.where(" AND ".join(f"abs({c}) < double('infinity')" for c in _AXES)).withColumn("grp", F.col("grp").cast("string"))
    points = finite(points)
    ids = points.withColumn("_r", F.row_number().over(Window.partitionBy("grp", *_AXES).orderBy("id"))).where(F.col("_r") <= k)
    spots = settle(ids.groupBy("grp", *_AXES).agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids")), "spots")
    placed, nodes, depth = build_tree(spots.drop("ids"))
    if depth:
        placed = settle(placed, "placed")
    if queries is None:
        queries = points.withColumnRenamed("id", "qid")
        asked = spots.select("grp", *_AXES, F.col("id").alias("qid")).alias("asked")
        home = settle(placed.select("grp", F.col("id").alias("qid"), *_AXES, "node"), "home")
    else:
        queries = finite(queries)
        asked = settle(queries.groupBy("grp", *_AXES).agg(F.min("qid").alias("qid")), "asked")
        # the leaf a query starts from is in the nearest child at every step
        one = Window.partitionBy("grp", "qid").orderBy("near", "far", "node")
        closest = lambda met: met.withColumn("_one", F.row_number().over(one)).where("_one = 1").drop("_one")
        home = settle(_walk(asked, nodes, depth, closest).select("grp", "qid", *_AXES, "node"), "home")
    first = settle(_scan(home, placed, k), "near")
    reach = first.groupBy("grp", "qid").agg(F.when(F.count("*") >= k, F.max("d2")).alias("reach"))
    start = home.withColumnRenamed("node", "home").join(reach, ["grp", "qid"], "left")
    all_of = Window.partitionBy("grp", "qid")

    def in_reach(met: DataFrame) -> DataFrame:
        """Children nearer than the k-th found so far; a child with k positions bounds the k-th by its far end."""
        bound = F.min(F.when(F.col("n") >= k, F.col("far"))).over(all_of)
        tight = met.withColumn("_b", bound).withColumn("reach", F.least("reach", F.col("_b") * (1 + 1e-12))).drop("_b")
        return tight.where(F.col("reach").isNull() | (F.col("near") <= F.col("reach") * (1 + 1e-12)))

    near = first
    if depth:  # one leaf a group has been seen whole
        visits = _walk(start, nodes, depth, in_reach).where("node <> home").select("grp", "qid", *_AXES, "node")
        near = first.unionByName(_scan(settle(visits, "visits"), placed, k))
    # positions back to ids: k positions of at most k ids each, ranked by (distance, id)
    last = Window.partitionBy("grp", "qid").orderBy("d2", "id")
    best = near.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= k).drop("_r")
    named = best.join(spots.select("grp", "id", "ids"), ["grp", "id"]).select("grp", "qid", "d2", F.explode("ids").alias("id"))
    ranked = named.withColumn("rank", F.row_number().over(last).cast("int")).where(F.col("rank") <= k)
    members = queries.select("grp", F.col("qid").alias("_q"), *_AXES).join(asked, ["grp", *_AXES]).select("grp", "_q", "qid")
    return members.join(ranked, ["grp", "qid"]).select("grp", F.col("_q").alias("qid"), "rank", "id", "d2")
