"""Merkle manifest of a dataset: leaves placed by bitmap ranks, levels reduced by slot, proofs and their check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbtable.llm.common import documents, settle

FAN_OUT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Bits of a word's number that a window spans: at most 4,096 rows.
SPAN = 12


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """`-` for null, else byte count, colon and value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _directory(words: DataFrame, keys: list[str]) -> DataFrame:
    """`words` (keys, word, bits, n) with `before`: rows of the group in smaller words.

    Counts go up a tree of spans of 2^SPAN words, spans of spans and so on, and offsets come down
    again, so that a window never holds more than 2^SPAN rows.
    """
    levels = [words.select(*keys, F.col("word").alias("at"), "n")]
    for _ in range(4):
        levels.append(levels[-1].groupBy(*keys, F.shiftright("at", SPAN).alias("at")).agg(F.sum("n").alias("n")))
    offset = None
    for level in reversed(levels):
        up = F.lit(0).cast("long") if offset is None else F.shiftright("at", SPAN)
        w = Window.partitionBy(*keys, "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        inside = level.withColumn("up", up).withColumn("_in", F.coalesce(F.sum("n").over(w), F.lit(0)))
        if offset is None:
            offset = inside.select(*keys, "at", F.col("_in").alias("before"))
        else:
            inside = _meet(inside, offset.withColumnRenamed("at", "up"), [*keys, "up"])
            offset = inside.select(*keys, "at", (F.col("_in") + F.col("before")).alias("before"))
    return _meet(words, offset.withColumnRenamed("at", "word"), [*keys, "word"])


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on `keys`, null equal to null."""
    r = right.select(*[F.col(k).alias("_r" + k) for k in keys], *[c for c in right.columns if c not in keys])
    test = None
    for k in keys:
        one = left[k].eqNullSafe(F.col("_r" + k))
        test = one if test is None else test & one
    return left.join(r, test).drop(*["_r" + k for k in keys])


def ranked(rows: DataFrame, keys: list[str], key: str, out: str) -> tuple[DataFrame, DataFrame]:
    """`rows` (.., n) with `out`, the number of rows of their group `keys` with a smaller `key`; and the keys shared by rows.

    A bitmap per group holds the keys (64-bit, signed order), as words of 64 bits that partitions combine by "or"
    before they move; a directory of counts gives a row its place by one lookup and a bit count, so
    nothing is sorted. `n` is how many times a row counts. The second table holds the values of (keys, key) that
    several rows of `rows` have: those share one place. Words with them are counted by key instead of by bit.
    """
    word, bit, rest = F.shiftright(key, 6), *[F.expr(f"shiftleft({x}L, cast({key} & 63 as int))") for x in (1, -1)]
    table = settle(rows.groupBy(*keys, word.alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.sum("n").alias("n"), F.count("*").alias("rows")), "bitmaps")
    table = settle(_directory(table, keys), "directory")
    met = _meet(rows.withColumn("word", word), table.select(
        *keys, "word", "bits", "before", (F.col("n") > F.bit_count("bits")).alias("crowded"), (F.col("rows") > F.bit_count("bits")).alias("tied")), [*keys, "word"])
    met = settle(met, "ranks")
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(rest)))
    plain = met.where("not crowded").withColumn(out, (F.col("before") + below).cast("long"))
    full = met.where("crowded")
    counts = full.groupBy(*keys, "word", F.col(key).alias("_k")).agg(F.sum("n").alias("_n"), F.count("*").alias("_rows"))
    w = Window.partitionBy(*keys, "word").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(w), F.lit(0)))  # 64 keys a word at most
    full = _meet(full.withColumn("_k", F.col(key)), counts.drop("word", "_n"), [*keys, "_k"]).withColumn(out, (F.col("before") + F.col("_in")).cast("long"))
    shared = counts.where("_rows > 1").select(*keys, F.col("_k").alias(key))
    keep = [*rows.columns, out]
    return plain.select(*keep).unionByName(full.select(*keep)), shared


def place_leaves(leaves: DataFrame) -> DataFrame:
    """`leaves` (lang, doc_id, leaf, n, ..) with `position`, counted from 0 in their lang.

    Leaves ascend by doc_id, null first; leaves of one doc_id by their digest. Places within a doc_id are
    ranks again, by bitmaps over the first 60 bits of the digest, then by the digest.
    """
    # a null doc_id goes by the side of the numbers, in a group of its own
    rows = leaves.withColumn("_null", F.col("doc_id").isNull()).withColumn("_id", F.coalesce("doc_id", F.lit(0)))
    placed, shared = ranked(rows, ["lang", "_null"], "_id", "position")
    nulls = leaves.where("doc_id IS NULL").groupBy("lang").agg(F.sum("n").alias("_ahead")).withColumn("_null", F.lit(False))
    if nulls.limit(1).count():
        langs = rows.select("lang").distinct().withColumn("_null", F.lit(False))
        ahead = langs.join(nulls.select(F.col("lang").alias("_l"), "_ahead"), F.col("lang").eqNullSafe(F.col("_l")), "left")
        ahead = settle(ahead.select("lang", "_null", F.coalesce("_ahead", F.lit(0)).alias("_ahead")), "ahead")
        moved = _meet(placed.where("not _null"), ahead, ["lang", "_null"]).withColumn("position", F.col("position") + F.col("_ahead")).drop("_ahead")
        placed = moved.unionByName(placed.where("_null"))
    shared = settle(shared, "shared")
    if not shared.limit(1).count():
        return placed.drop("_null", "_id")
    placed, on = settle(placed, "placed"), ["lang", "_null", "_id"]
    marked = _meet(placed.select(*on).distinct(), shared, on).withColumn("_several", F.lit(True))
    joined = placed.join(marked.select(*[F.col(c).alias("_m" + c) for c in on], "_several"),
                         F.col("lang").eqNullSafe(F.col("_mlang")) & (F.col("_null") == F.col("_m_null")) & (F.col("_id") == F.col("_m_id")), "left")
    joined = settle(joined.drop(*["_m" + c for c in on]), "placed")
    several = joined.where("_several").withColumn("_h", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"))
    inner, _ = ranked(several, on, "_h", "_more")
    w = Window.partitionBy(*on, "_h").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.sum("n").over(w), F.lit(0))  # leaves of one doc_id that share 60 bits
    inner = inner.withColumn("position", (F.col("position") + F.col("_more") + last).cast("long")).drop("_h", "_more")
    return joined.where("_several IS NULL").unionByName(inner).drop("_null", "_id", "_several")


def _levels(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Levels of the trees of all groups from the bottom: (grp, run, size, kids), size being the nodes of the group there.

    `nodes` are (grp, position, hash, load). kids lists (slot, hash, load) of a run, FAN_OUT at most; only the lowest
    level has loads. A group whose one node is left is done; a level is an eighth of the one below it,
    and the largest group gives the number of rounds.
    """
    sizes = settle(nodes.groupBy("grp").agg((F.max("position") + 1).alias("size")), label)
    most = sizes.agg(F.max("size")).first()[0] or 0
    now, levels = _meet(nodes, sizes, ["grp"]), []
    while most > 1:
        slot = F.col("position").bitwiseAND(FAN_OUT - 1).cast("int").alias("slot")
        kid = F.struct(slot, "hash", "load") if not levels else F.struct(slot, "hash")
        runs = now.where("size > 1").groupBy("grp", F.shiftright("position", 3).alias("run"), "size").agg(F.collect_list(kid).alias("kids"))
        # the slot says where a kid goes
        levels.append(settle(runs.withColumn("kids", F.array_sort("kids", lambda a, b: a["slot"] - b["slot"])), label))
        now = levels[-1].select("grp", F.col("run").alias("position"), digest(F.concat_ws("", F.col("kids")["hash"])).alias("hash"),
                                F.ceil(F.col("size") / FAN_OUT).alias("size"))
        most = -(-most // FAN_OUT)
    return levels


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, top): the node that is left of each group."""
    tops = nodes.groupBy("grp").agg(F.max("position").alias("last"), F.max("hash").alias("top")).where("last = 0").select("grp", "top")
    for runs in levels:
        tops = tops.unionByName(runs.where(F.col("size") <= FAN_OUT).select("grp", digest(F.concat_ws("", F.col("kids")["hash"])).alias("top")))
    return tops


def _with_paths(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, label: str) -> DataFrame:
    """(grp, hash, load, path, and the other columns of `above`) of every node.

    A path lists what stands left and right of the node in its run, then of the run in its own run, up to
    the top of the group, and goes on with the `path` of `above` (grp, path, ..). Paths come down level
    by level; those of the nodes themselves are made where they are read and not written.
    """
    extra = [c for c in above.columns if c not in ("grp", "path")]
    goal = above.withColumn("run", F.lit(0).cast("long"))
    lone = nodes.groupBy("grp").agg(F.max("position").alias("last"), F.max(F.struct("hash", "load")).alias("kid")).where("last = 0")
    out = _meet(lone, above, ["grp"]).select("grp", "kid.hash", "kid.load", "path", *extra)
    path = None
    for runs in reversed(levels):
        met = _meet(runs.where(F.col("size") <= FAN_OUT), goal, ["grp", "run"])
        if path is not None:
            met = met.unionByName(_meet(runs.where(F.col("size") > FAN_OUT), path, ["grp", "run"]))
        hashes = F.col("kids")["hash"]
        left, right = F.slice(hashes, 1, F.col("kid.slot")), F.slice(hashes, F.col("kid.slot") + 2, FAN_OUT)
        step = F.struct(F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right"))
        kids = met.withColumn("kid", F.explode("kids")).withColumn("path", F.concat(F.array(step), F.col("path")))
        if runs is levels[0]:
            return out.unionByName(kids.select("grp", "kid.hash", "kid.load", "path", *extra))
        path = settle(kids.select("grp", (F.col("run") * FAN_OUT + F.col("kid.slot")).alias("run"), "path", *extra), label)
    return out


def _numbered(groups: DataFrame) -> DataFrame:
    """`groups` (lang, ..) with `position` in the order of lang, null first: ranges, then places within a range."""
    dealt = settle(groups.repartitionByRange(F.col("lang").asc_nulls_first()).withColumn("range", F.spark_partition_id()), "groups")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))  # one row per range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("lang").asc_nulls_first())) - 1
    return dealt.withColumn("_in", inside).join(offsets, "range").withColumn("position", (F.col("_off") + F.col("_in")).cast("long")).drop("range", "_in", "_off")


def leaf_of(text: Column) -> Column:
    """Digest of a row of documents with `text` as its text."""
    return digest(*[framed(text if c == "text" else F.col(c)) for c in FIELDS])


def manifest(docs: DataFrame, found: Column) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, found, subroot, root, path.

    `found` is what a later reader sees as the row's leaf, an expression over `docs`. A path lists the siblings
    (left, right) of the leaf's run, of the run's run and so on through the lang's subroot to the root. Rows that
    agree in doc_id, lang and leaf are leaves of their own, side by side; a null doc_id comes first and
    several leaves of one doc_id ascend by digest; so the root depends on the rows alone, not on their order. A
    null lang is a group of its own. An empty table has no rows and no root. The text is read once.
    """
    leaves = settle(docs.select("lang", "doc_id", leaf_of(F.col("text")).alias("leaf"), found.alias("found")), "leaves")
    rows = leaves.groupBy("lang", "doc_id", "leaf").agg(F.max("found").alias("found"), F.count("*").alias("n"))
    placed = place_leaves(rows)
    each = F.explode(F.sequence(F.col("position"), F.col("position") + F.col("n") - 1))
    nodes = placed.select(F.col("lang").alias("grp"), each.alias("position"), F.col("leaf").alias("hash"), F.struct("doc_id", "found").alias("load"))
    nodes = settle(nodes, "nodes")
    levels = _levels(nodes, "level")
    subroots = settle(_numbered(_tops(nodes, levels).withColumnRenamed("grp", "lang")), "subroots")
    upper = subroots.select(F.lit(0).alias("grp"), "position", F.col("top").alias("hash"), F.struct("lang").alias("load"))
    upper_levels = _levels(upper, "upper")
    ends = _tops(upper, upper_levels).select("grp", F.col("top").alias("root"), F.array().cast("array<struct<left: string, right: string>>").alias("path"))
    above = _with_paths(upper, upper_levels, ends, "way").select(F.col("load.lang").alias("grp"), F.col("hash").alias("subroot"), "root", "path")
    return _with_paths(nodes, levels, settle(above, "above"), "way").select(
        "load.doc_id", F.col("hash").alias("leaf"), "load.found", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    return digest(F.concat_ws("", F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"])))))


def fold(leaf: Column, path: Column) -> Column:
    """The root that `leaf` and the siblings of `path` give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def check_tampering(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 3 divides crc32(doc_id) the row is read again with the text's A-Z in lower case, else as it is.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    text = F.col("text")
    made = manifest(docs, leaf_of(F.when(hit, lower_ascii(text)).otherwise(text)))
    out = made.withColumn("folded_root", fold(F.col("found"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all `documents`, checked against a tampered reading."""
    return check_tampering(documents(spark, sf_dir))


def _sql_tree(name: str, rounds: int) -> str:
    """CTEs over `name`0 (grp, pos, h): nodes per level with what stands left and right of them, and the group's top."""
    out = []
    for k in range(rounds):
        out.append(f"""
{name}{k}s AS (SELECT *, count(*) OVER (PARTITION BY grp) AS size, list(h) OVER (PARTITION BY grp, pos // 8 ORDER BY pos
                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {name}{k}),
{name}{k}p AS (SELECT grp, pos, h, size, CASE WHEN size > 1 THEN array_to_string(run[1:pos % 8], '') ELSE '' END AS l,
                      CASE WHEN size > 1 THEN array_to_string(run[pos % 8 + 2:], '') ELSE '' END AS r FROM {name}{k}s),
{name}{k + 1} AS (SELECT grp, pos // 8 AS pos, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
                  FROM {name}{k}p GROUP BY grp, pos // 8),""")
    return "".join(out)


def _sql() -> str:
    low, high = 9, 3  # 8^9 documents of a lang, 8^3 langs
    field = lambda e: f"coalesce(strlen({e})::VARCHAR || ':' || {e}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else f"{c}::VARCHAR") for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ops = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {ops}), lambda a, x: {step}), 4294967295)"
    joins = "".join(f" JOIN n{k}p ON n{k}p.grp IS NOT DISTINCT FROM t.lang AND n{k}p.pos = t.pos // {8 ** k}" for k in range(low))
    joins += f" JOIN n{low} ON n{low}.grp IS NOT DISTINCT FROM t.lang JOIN g ON g.grp IS NOT DISTINCT FROM t.lang"
    joins += "".join(f" JOIN u{k}p ON u{k}p.pos = g.pos // {8 ** k}" for k in range(high)) + f" CROSS JOIN u{high}"
    tables = [f"n{k}p" for k in range(low)] + [f"u{k}p" for k in range(high)]
    folds, now = "", "found"
    for k, t in enumerate(tables):
        folds += f",\nf{k} AS (SELECT *, CASE WHEN many{k} THEN sha256(l{k} || {now} || r{k}) ELSE {now} END AS v{k} FROM {'p' if not k else f'f{k - 1}'})"
        now = f"v{k}"
    sides = ", ".join(f"{t}.l AS l{k}, {t}.r AS r{k}, {t}.size > 1 AS many{k}" for k, t in enumerate(tables))
    proof = " || ".join(f"l{k} || r{k}" for k in range(len(tables)))
    return f"""
WITH d AS (SELECT *, coalesce({crc} % 3 = 0, false) AS hit FROM documents),
h AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN hit THEN {leaf(lower)} ELSE {leaf('text')} END AS found FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
n0 AS (SELECT lang AS grp, pos, leaf AS h FROM t),{_sql_tree("n", low)}
g AS (SELECT grp, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos FROM n{low}),
u0 AS (SELECT 0 AS grp, pos, h FROM g),{_sql_tree("u", high)}
p AS (SELECT t.*, n{low}.h AS subroot, u{high}.h AS root, {sides} FROM t{joins}){folds}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {now} AS folded_root, {now} = root AS verified FROM f{len(tables) - 1}
"""


SQL = _sql()
