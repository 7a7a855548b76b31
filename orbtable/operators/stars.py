"""Triangulation of clouds on the sphere by star splaying: every point keeps its own ring until all rings agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbtable.functions.vec import unit_columns, vec
from orbtable.operators.spatial import knn_join
from orbtable.session import settle, small_batches

_POINTS = "ids array<bigint>, xs array<double>, ys array<double>, zs array<double>"
#: Rows of the exchange: a star, a triangle that the receiver should have, a point that it should know.
STAR, CLAIM, WITNESS = 0, 1, 2
#: Padded candidates handled at once.
_BLOCK = 1 << 20
#: Stars with their messages that a task holds in Python at a time.
_STARS = 1000
#: Directions nearer to each other than this are one point.
APART = 1e-7


def _inverted(centre: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Plane positions of `around` (rows, m, 3) by inversion about `centre` (rows, 3), which is on the unit sphere.

    Circles through the centre become lines, so the triangles at the centre whose circle holds no point
    are the edges of the convex hull of the inverted points.
    """
    axis = np.zeros_like(centre)
    axis[np.arange(len(centre)), np.abs(centre).argmin(1)] = 1
    e1 = np.cross(centre, axis)
    e1 /= np.linalg.norm(e1, axis=1, keepdims=True)
    e2 = np.cross(centre, e1)
    d = around - centre[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.stack([np.einsum("bmk,bk->bm", d, e) for e in (e1, e2)], 2) / (d * d).sum(2)[..., None]


def _hulls(xy: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of every row of `xy` (rows, m, 2) where `there`: positions in the row, then -1.

    All rows are wrapped at once: a step turns from the last edge to the next point of each row.
    """
    rows = np.arange(len(xy))
    start = np.where(there, xy[..., 0], -np.inf).argmax(1)
    at, way, out = start, np.tile([0.0, 1.0], (len(xy), 1)), []
    active = there.sum(1) >= 3
    while active.any() and len(out) <= xy.shape[1]:
        out.append(np.where(active, at, -1))
        v = xy - xy[rows, at][:, None]
        turn = np.arctan2(way[:, None, 0] * v[..., 1] - way[:, None, 1] * v[..., 0], way[:, None, 0] * v[..., 0] + way[:, None, 1] * v[..., 1])
        turn = np.where(turn < -1e-12, turn + 2 * np.pi, turn)
        turn[~there | (np.abs(v).sum(2) == 0)] = np.inf
        to = turn.argmin(1)
        way, at = xy[rows, to] - xy[rows, at], np.where(active, to, at)
        active = active & (to != start)
    return np.stack(out, 1) if out else np.full((len(xy), 0), -1)


def _edges(rings: np.ndarray) -> pd.DataFrame:
    """(row, u, v) of consecutive entries of rings padded with -1."""
    size = (rings >= 0).sum(1)
    row, k = np.nonzero(rings >= 0)
    return pd.DataFrame({"row": row, "u": rings[row, k], "v": rings[row, np.where(k + 1 < size[row], k + 1, 0)]})


def _missing(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    """Rows (row, u, v) of `one` that `two` lacks, each once."""
    one = one.drop_duplicates()
    return one[~pd.MultiIndex.from_frame(one).isin(pd.MultiIndex.from_frame(two))]


def _meet(part: pd.DataFrame) -> pd.DataFrame:
    """The new rings of some stars, and what they have to tell others."""
    n = len(part)
    centre = part[["x", "y", "z"]].to_numpy(float)
    flat = lambda old, new: np.concatenate([*part[old], *part[new]]) if n else np.zeros(0)
    owner = np.concatenate([np.repeat(np.arange(n), part[c].str.len().to_numpy(int)) for c in ("ids", "m_ids")])
    known = pd.DataFrame({"row": owner, "id": flat("ids", "m_ids"), **{c: flat(c, "m_" + c) for c in ("xs", "ys", "zs")}})
    known = known[known["id"].to_numpy() != part["p"].to_numpy()[known["row"]]].drop_duplicates(["row", "id"]).sort_values(["row", "id"])
    row, size = known["row"].to_numpy(), np.bincount(known["row"], minlength=n)
    place = np.arange(len(known)) - (np.cumsum(size) - size)[row]
    at = np.full((n, max(1, size.max(initial=0))), -1, np.int64)
    at[row, place] = known["id"]
    around = np.zeros((*at.shape, 3))
    around[row, place] = known[["xs", "ys", "zs"]].to_numpy()
    xy = _inverted(centre, around)
    rings = _hulls(xy, at >= 0)  # positions
    named = np.where(rings >= 0, np.take_along_axis(at, np.maximum(rings, 0), 1), -1)
    now = _edges(named)
    old = np.full((n, max(1, part["ids"].str.len().max())), -1, np.int64)
    for k, ids in enumerate(part["ids"]):
        old[k, :len(ids)] = ids
    claims = [(k, s, r) for k, (kinds, pairs) in enumerate(zip(part["m_kind"], part["m_pairs"])) for kind, s, r in zip(kinds, pairs[::2], pairs[1::2]) if kind == CLAIM]
    claims = pd.DataFrame(claims, columns=["row", "u", "v"]).astype(np.int64)
    # triangles that are new here are told to their two other corners
    fresh = _missing(now, _edges(old))
    cloud, p = part["cloud_id"].to_numpy(), part["p"].to_numpy()
    spot = known.set_index(["row", "id"])
    look = lambda r, i: spot.loc[pd.MultiIndex.from_arrays([r, i]), ["xs", "ys", "zs"]].to_numpy()
    told = []

    def tell(r, to, kind, ids, xyz):
        told.append(pd.DataFrame({"cloud_id": cloud[r], "p": to, "kind": kind, "ids": list(ids), "xs": list(xyz[..., 0]), "ys": list(xyz[..., 1]), "zs": list(xyz[..., 2])}))

    if len(fresh):
        r, u, v = (fresh[c].to_numpy() for c in ("row", "u", "v"))
        xu, xv = look(r, u), look(r, v)
        tell(r, u, CLAIM, np.stack([v, p[r]], 1), np.stack([xv, centre[r]], 1))
        tell(r, v, CLAIM, np.stack([p[r], u], 1), np.stack([centre[r], xu], 1))
    # a triangle that others have or had from here, but this star has not, holds a point of this ring in its circle
    against = _missing(pd.concat([_edges(old), claims]), now)
    if len(against):
        r, u, v = (against[c].to_numpy() for c in ("row", "u", "v"))
        places = pd.Series(place, index=pd.MultiIndex.from_arrays([row, known["id"]]))
        a, b = (xy[r, places.loc[pd.MultiIndex.from_arrays([r, i])].to_numpy()] for i in (u, v))
        ring = rings[r]
        o = np.take_along_axis(xy[r], np.maximum(ring, 0)[..., None], 1) - a[:, None]
        side = np.where(ring >= 0, (b - a)[:, None, 0] * o[..., 1] - (b - a)[:, None, 1] * o[..., 0], np.inf)
        deepest = side.argmin(1)
        outside = side[np.arange(len(r)), deepest] < 0
        w = named[r, deepest]
        for to in (u, v):
            keep = outside & (to != w)
            if keep.any():
                tell(r[keep], to[keep], WITNESS, w[keep][:, None], look(r[keep], w[keep])[:, None])
    lengths = (rings >= 0).sum(1)
    cut = lambda values: [x[:k] for x, k in zip(values, lengths)]
    xyz = np.take_along_axis(around, np.maximum(rings, 0)[..., None], 1)
    stars = pd.DataFrame({"cloud_id": cloud, "p": p, "kind": STAR, "ids": cut(named), "xs": cut(xyz[..., 0]), "ys": cut(xyz[..., 1]), "zs": cut(xyz[..., 2])})
    changed = np.zeros(n, bool)
    changed[np.r_[fresh["row"].to_numpy(int), _missing(_edges(old), now)["row"].to_numpy(int)]] = True
    return pd.concat([stars.assign(changed=changed), *[t.assign(changed=False) for t in told]])


def _round(stars: DataFrame, messages: DataFrame) -> DataFrame:
    """(cloud_id, p, kind, points, changed): stars that got messages with their new rings, and the messages they send."""
    said = messages.groupBy("cloud_id", "p").agg(F.collect_list(F.struct("kind", "ids", "xs", "ys", "zs")).alias("m"))
    pair = F.transform("m", lambda m: F.array(m["ids"][0], F.element_at(m["ids"], -1)))
    got = stars.join(said, ["cloud_id", "p"]).select(
        "cloud_id", "p", "x", "y", "z", "ids", "xs", "ys", "zs", F.col("m.kind").alias("m_kind"), F.flatten(pair).alias("m_pairs"),
        *[F.flatten(F.col("m." + c)).alias("m_" + c) for c in ("ids", "xs", "ys", "zs")])

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            size = part["ids"].str.len() + part["m_ids"].str.len()
            part = part.iloc[np.argsort(size, kind="stable")]  # stars of like size share a block, so little is padded
            size, a = np.sort(size.to_numpy()), 0
            while a < len(part):
                b = a + 1
                while b < len(part) and (b + 1 - a) * size[b] <= _BLOCK:
                    b += 1
                yield _meet(part.iloc[a:b].reset_index(drop=True))
                a = b

    return got.mapInPandas(meet, f"cloud_id string, p bigint, kind int, {_POINTS}, changed boolean")


def distinct_directions(points: DataFrame) -> DataFrame:
    """(cloud_id, p, x, y, z): unit directions at least APART from each other, each with the smallest id of those it stands for.

    Cells of eight times that size, moved four times by a quarter along the diagonal, hold any nearer pair at least
    once. A zero or null position has no direction.
    """
    out = points.where("x * x + y * y + z * z > 0").select(F.col("cloud_id").cast("string").alias("cloud_id"), "p", *unit_columns(vec(""), ""))
    for k in range(4):
        cell = [F.floor(F.col(c) / (8 * APART) + k / 4).alias("_" + c) for c in "xyz"]
        out = out.groupBy("cloud_id", *cell).agg(F.min(F.struct("p", "x", "y", "z")).alias("s")).select("cloud_id", "s.*")
    return out


def splay(points: DataFrame, k: int = 12, jitter: float = 1e-9) -> DataFrame:
    """stars(cloud_id, p, ring): the neighbours of every point in the Delaunay triangulation of its cloud, counter-clockwise.

    A star is built from what its point knows: at first its k nearest and six outermost points of the
    cloud, which all stars share. It tells the corners of each new triangle about it, and who lacks a triangle that others
    claim answers with a point inside its circle. Knowledge only grows, a ring sums it up without loss, and a
    round moves messages of changed stars alone. When nothing is left to say all rings agree; as all
    know the same outermost points the agreed surface is connected, hence the convex hull.
    No cloud is gathered: a task holds some stars, and a star its own neighbours and messages.

    Of points in one direction (`distinct_directions`) the smallest id stays; clouds of fewer than four directions
    have no stars. Points are moved by about `jitter` by their id, so that four on a circle
    are treated alike by all stars. Ids need not be dense; cloud_id comes back as a string.
    """
    one = distinct_directions(points)
    shake = lambda c, seed: (F.col(c) + F.lit(jitter) * (F.pmod(F.xxhash64("p", F.lit(seed)), F.lit(1 << 20)) / F.lit(1 << 20) - 0.5)).alias(c)
    moved = one.select("cloud_id", "p", *[shake(c, s) for s, c in enumerate("xyz")])
    moved = settle(moved.select("cloud_id", "p", *unit_columns(vec(""), "")), "cloud")
    at = F.struct("p", "x", "y", "z")
    far = moved.groupBy("cloud_id").agg(F.count("*").alias("n"), F.array(*[f(at, F.struct(c, "p")) for c in "xyz" for f in (F.min_by, F.max_by)]).alias("far"))
    far = settle(far.where("n >= 4"), "far")
    seen = knn_join(moved, k + 1).where("p <> q").select("cloud_id", "p", "q")
    seen = seen.join(moved.select("cloud_id", F.col("p").alias("q"), "x", "y", "z"), ["cloud_id", "q"])
    seen = seen.groupBy("cloud_id", "p").agg(F.collect_list(F.struct(F.col("q").alias("p"), "x", "y", "z")).alias("near"))
    first = moved.join(seen, ["cloud_id", "p"], "left").join(far, "cloud_id").select("cloud_id", "p", F.concat(F.coalesce("near", F.array()), "far").alias("w"))
    messages = first.select("cloud_id", "p", F.lit(WITNESS).alias("kind"), *[F.col("w." + a).alias(b) for a, b in zip("pxyz", ("ids", "xs", "ys", "zs"))])
    none = [F.array().cast(t).alias(c) for c, t in (("ids", "array<bigint>"), ("xs", "array<double>"), ("ys", "array<double>"), ("zs", "array<double>"))]
    stars = moved.select("cloud_id", "p", "x", "y", "z", *none)
    while True:
        with small_batches(stars.sparkSession, _STARS):
            said = settle(_round(stars, messages), "splay")
        new = said.where(F.col("kind") == STAR)
        rings = stars.select("cloud_id", "p", "x", "y", "z").join(new.drop("kind", "changed"), ["cloud_id", "p"])
        stars = settle(rings.unionByName(stars.join(new.select("cloud_id", "p"), ["cloud_id", "p"], "left_anti")), "stars")
        messages = said.where(F.col("kind") != STAR).drop("changed")
        if not new.where("changed").limit(1).count():
            return stars.where("size(ids) > 0").select("cloud_id", "p", F.col("ids").alias("ring"))


def sphere_mesh(points: DataFrame, k: int = 12) -> DataFrame:
    """faces(cloud_id, a, b, c) of the convex hull of the directions of `points`, outward, the smallest corner first.

    On a sphere that is the Delaunay triangulation: 2n - 4 faces for n directions, Euler characteristic 2.
    """
    ring = F.col("ring")
    pairs = F.arrays_zip(ring.alias("b"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("c"))
    each = splay(points, k).select("cloud_id", F.col("p").alias("a"), F.explode(pairs).alias("e"))
    return each.select("cloud_id", "a", F.col("e.b").alias("b"), F.col("e.c").alias("c")).where("a < b AND a < c")


def closure(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(cloud_id, n, nf, euler): directions, faces and Euler characteristic of every cloud with a mesh."""
    n = distinct_directions(points).groupBy("cloud_id").agg(F.count("*").alias("n"))
    corner = faces.select("cloud_id", F.inline(F.array(*[F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")) for u, v in (("a", "b"), ("b", "c"), ("c", "a"))])))
    edges = corner.distinct().groupBy("cloud_id").agg(F.count("*").alias("ne"))
    used = corner.select("cloud_id", F.explode(F.array("u", "v")).alias("p")).distinct().groupBy("cloud_id").agg(F.count("*").alias("nv"))
    nf = faces.groupBy("cloud_id").agg(F.count("*").alias("nf"))
    return nf.join(edges, "cloud_id").join(used, "cloud_id").join(n, "cloud_id").select("cloud_id", "n", "nf", (F.col("nv") - F.col("ne") + F.col("nf")).alias("euler"))
