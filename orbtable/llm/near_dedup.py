"""MinHash near-dedup with SetSketch registers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import (
    BATCH, attach_groups, body, components, documents, for_python, from_python, row_print, settle, settle_python, worker_memo,
)
from orbtable.llm.exchange import mix
from orbtable.llm.wordsplit import Memo
from orbtable.session import small_batches

#: Registers of a sketch, and registers of a band: BANDS keys of ROWS registers each. Two sets of
#: similarity 0.8 miss each other in every band with probability (1 - 0.8**4)**32 < 5e-8.
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
#: Base and rate of the exponential spacing.
BASE, RATE = 1.02, 20.0
#: A row whose likeliest similarity to a leader is this is represented by it; and this joins it loosely.
INNER, BALL = 0.7, 0.3
#: Sets compared in one task, and bytes of them.
GROUP_SETS, GROUP_BYTES = 512, 16 << 20


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, REGISTERS, np.uint64), rng.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


class Sketcher:
    """Distinct hashed shingles of a text, and the SetSketch registers of a set."""

    def __init__(self, width: int):
        self.width = width
        self.words = worker_memo("shingle_words").setdefault("memo", Memo(xxhash.xxh3_64_intdigest))
        self.flip, self.odd = _constants()

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of `width` words in a row; of fewer words, the whole sequence."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        out = h[:max(1, len(h) - self.width + 1)]
        for k in range(1, min(self.width, len(h))):
            out = mix(out, h[k:k + len(out)])
        return np.unique(out)

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        """Per register the exponentially spaced, truncated minimum of the set's exponential variates."""
        low = np.full(REGISTERS, 2**64 - 1, np.uint64)
        for a in range(0, len(shingles), 256):
            low = np.minimum(low, ((shingles[a:a + 256, None] ^ self.flip) * self.odd).min(axis=0))
        u = (low.astype(np.float64) + 1) / 2.0**64
        x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
        return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype("<u2")


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of greatest likelihood of sketches `a` and `b` (n x REGISTERS) of sets of known sizes.

    It judges jointly how many registers are greater, less and equal, on a grid of similarities.
    """
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 41)[None] * top
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    pm, pl = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = sum(np.where(n > 0, n * np.log(q), 0) for n, q in ((more, pm), (less, pl), (REGISTERS - more - less, 1 - pm - pl)))
    return np.take_along_axis(j, np.nan_to_num(worth, nan=-np.inf).argmax(axis=1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n_shingles, node (digest of the set; null without words) and registers of every row."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Sketcher(width)
        for part in parts:
            rows = []
            for text in part["text"]:
                s = tool.shingles(text)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, tool.registers(s).tobytes() if len(s) else None))
            out = pd.DataFrame(rows, columns=["n_shingles", "node", "registers"])
            out.insert(0, "row", part["row"].to_numpy())
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield out

    return from_python(for_python(docs, row_print().alias("row")).mapInPandas(
        run, "doc_id string, row long, n_shingles long, node binary, registers binary"))


def _bands(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per band of each sketch."""
    for part in parts:
        keys = np.frombuffer(b"".join(part["registers"]), "<u8").reshape(-1, BANDS)
        keys = mix(keys, np.broadcast_to(np.arange(BANDS, dtype=np.uint64), keys.shape))
        yield pd.DataFrame({"band": keys.ravel().view(np.int64), "node": np.repeat(part["node"].to_numpy(), BANDS)})


def _shared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by band, those that share theirs with a neighbour."""
    last = None
    for part in parts:
        part = part if last is None else pd.concat([last, part], ignore_index=True)
        same = np.append(False, part["band"].to_numpy()[1:] == part["band"].to_numpy()[:-1])
        known = part["known"].to_numpy() | same | np.append(same[1:], False)
        last = part.iloc[-1:].assign(known=known[-1:])
        yield part.iloc[:-1][known[:-1]][["band", "node"]]
    if last is not None:
        yield last[last["known"]][["band", "node"]]


def _loose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges that span the loosely similar rows of each band key; rows come sorted by band.

    The first row that no leader represents becomes a leader. Each row is judged against the leaders
    before it. If x and y are linked, x's leader is similar enough to y for both to be joined, so
    every link lies inside a component of these edges. Only leaders are held, and only those edges
    leave that join what was not joined in this band key.
    """
    band, leaders, sizes, names, root = None, None, None, [], []

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for part in parts:
        bands = part["band"].to_numpy()
        regs = np.frombuffer(b"".join(part["registers"]), "<u2").reshape(-1, REGISTERS)
        size, nodes = part["n_shingles"].to_numpy(np.float64), part["node"].tolist()
        cuts = np.flatnonzero(np.append(True, bands[1:] != bands[:-1])).tolist() + [len(bands)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            if bands[a] != band:
                band, leaders, sizes, names, root = bands[a], np.zeros((0, REGISTERS), "<u2"), np.zeros(0), [], []
            best, who = np.zeros(b - a), np.zeros(b - a, np.int64)
            close: list[set] = [set() for _ in range(b - a)]

            def judge(k, begin):
                n = b - a - begin
                est = likely_similarity(np.broadcast_to(leaders[k], (n, REGISTERS)), regs[a + begin:b], np.full(n, sizes[k]), size[a + begin:b])
                for i in np.flatnonzero(est >= BALL).tolist():
                    close[begin + i].add(k)
                better = est > best[begin:]
                best[begin:][better], who[begin:][better] = est[better], k

            for k in range(len(names)):
                judge(k, 0)
            for i in range(b - a):
                if best[i] < INNER:
                    names.append(nodes[a + i])
                    root.append(len(names) - 1)
                    leaders, sizes = np.vstack([leaders, regs[a + i:a + i + 1]]), np.append(sizes, size[a + i])
                    if i + 1 < b - a:
                        judge(len(names) - 1, i + 1)
                    mine = len(names) - 1
                else:
                    mine = int(who[i])
                    out.append((names[mine], nodes[a + i]))
                for k in close[i]:
                    x, y = top(k), top(mine)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((names[k], nodes[a + i]))
        yield pd.DataFrame(out, columns=["a", "b"])


class Postings:
    """Which of some sets hold a hash."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner, self.sizes = flat[order], owner[order], np.array([len(s) for s in sets])

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets that share `percent` of the union with `s`, counted on the full sets."""
        a, b = np.searchsorted(self.keys, s), np.searchsorted(self.keys, s, side="right")
        n = b - a
        at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (len(s) + self.sizes - both))


def link_group(sets: list[np.ndarray], percent: int) -> list[int]:
    """Smallest number reachable from each set through links, all links among `sets` considered.

    Sets are looked up until the largest class stops growing; then only sets outside it, since a link
    between two classes has an end outside the largest.
    """
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index, done = Postings(sets), np.zeros(len(sets), bool)
    while True:
        tops = np.array([top(i) for i in range(len(sets))])
        large = np.bincount(tops).argmax()
        rest = np.flatnonzero(~done & (tops != large))
        if not len(rest):
            return tops.tolist()
        for i in (rest[:1] if len(rest) == len(sets) else rest).tolist():
            done[i] = True
            for k in index.linked(sets[i], percent).tolist():
                x, y = top(i), top(k)
                root[max(x, y)] = min(x, y)


def near_copies(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased; a document is the set of its distinct shingles
    of `width` words (of fewer words, of the whole sequence). Documents are linked when at least
    `percent` of the union is shared. component_id is the smallest doc_id reachable through links.

    Equal sets are one node. Bands of SetSketch registers find the nodes that may be linked; in each
    band key leaders represent what is similar to them by joint likelihood, which gives loose
    components; their sets are compared in full, in blocks, without a row per pair. Without words or
    text a document has an empty set, is linked with nothing and is its own component. A repeated
    doc_id is one document with every text it has; a null doc_id never names a component, and a
    component without ids has null, its rows counting as kept.
    """
    prints = settle_python(sketches(docs, width), "sketches")
    nodes = settle(prints.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.count("*").alias("size")), "nodes")
    total = prints.count()
    shown = settle(prints.where("node IS NOT NULL").join(nodes.select("node", "row"), ["node", "row"], "left_semi").dropDuplicates(["node"]).select("node", "row", "n_shingles", "registers"), "shown")

    keys = shown.select("node", "registers").mapInPandas(_bands, "band long, node binary")
    ordered = keys.withColumn("known", F.lit(False)).repartition("band").sortWithinPartitions("band", "node")
    shared = ordered.mapInPandas(_shared, "band long, node binary")
    judged = shared.join(shown.select("node", "n_shingles", "registers"), "node").repartition("band").sortWithinPartitions("band", "node")
    loose = components(judged.mapInPandas(_loose, "a binary, b binary"))

    # the sets of what is loosely similar, in groups of bounded size
    class_ = loose.join(shown.select("node", "row", "n_shingles"), "node")
    sizes = class_.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / GROUP_SETS, F.sum("n_shingles") * 8 / GROUP_BYTES)).cast("int").alias("blocks"))
    class_ = settle(class_.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "classes")

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Sketcher(width)
        for part in parts:
            yield part.drop(columns="text").assign(shingles=[tool.shingles(t).tobytes() for t in part["text"]])

    texts = docs.select(row_print().alias("row"), body().alias("text")).join(class_.select("row", "node", "component", "block", "blocks").hint("shuffle_hash"), "row")
    sets = texts.select("node", "component", "block", "blocks", "text").mapInPandas(build, "node binary, component binary, block int, blocks int, shingles binary")
    # a class of several blocks meets in every pair of blocks
    other = F.when(F.col("blocks") < 2, F.array(F.col("block"))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
    paired = sets.withColumn("other", F.explode(other)).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node", ignore_index=True)
        found = link_group([np.frombuffer(s, "<u8") for s in group["shingles"]], percent)
        on = np.flatnonzero(np.array(found) != np.arange(len(found)))
        return pd.DataFrame({"a": group["node"].take(np.array(found)[on]).to_numpy(), "b": group["node"].take(on).to_numpy()})

    linked = paired.select("component", "low", "high", "node", "shingles").groupBy("component", "low", "high").applyInPandas(link, "a binary, b binary")
    with small_batches(docs.sparkSession, BATCH):  # texts pass Python once more
        strict = components(linked)
    named = nodes.join(strict, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes_ = settle(named.join(smallest, "component").select("node", "size", "component_id"), "named")
    own = prints.select("doc_id", "n_shingles", "node")
    out = attach_groups(own.where("node IS NOT NULL"), nodes_, "node", "size", total).select("doc_id", "n_shingles", "component_id")
    out = out.union(own.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose document stays, one of each group, with their own columns."""
    lost = near_copies(docs, width, percent).where("not kept").select(F.col("doc_id").alias("_lost_id")).distinct()
    return docs.join(lost.hint("shuffle_hash"), docs.doc_id.eqNullSafe(F.col("_lost_id")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies in `documents` by shingles of two words."""
    return near_copies(documents(spark, sf_dir))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS gs FROM w),
s AS (SELECT doc_id, unnest(gs) AS s FROM g),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y WHERE 100 * both_n >= 80 * (len(a.gs) + len(b.gs) - both_n)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM sym UNION SELECT r.x, l.y FROM reach r JOIN sym l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT g.doc_id, CAST(len(gs) AS BIGINT) AS n_shingles, least(g.doc_id, coalesce(m, g.doc_id)) AS component_id, g.doc_id <= coalesce(m, g.doc_id) AS kept
FROM g LEFT JOIN c ON c.x = g.doc_id
"""
