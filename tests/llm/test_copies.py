"""Exact copies, near copies and repeated strings against brute force."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np

from orbtable.llm import exact_dedup, near_dedup, suffix_dedup

words_of = lambda text: (text or "").encode().lower().split()
sha = lambda b: hashlib.sha256(b).hexdigest()


def test_exact_copies(docs, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = Counter()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        want[i, keep, len(groups[t or ""]), i == keep, sha((t or "").encode())] += 1
    assert Counter(map(tuple, exact_dedup.mark_copies(docs).collect())) == want


def test_exact_copies_dropped(docs, rows):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    kept = Counter(r["doc_id"] for r in left.select("doc_id").collect())
    assert kept[1] == kept[10] == 0 and kept[11] == 2 and kept[7] == 1


def test_hot_groups_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr("orbtable.llm.common.HOT_GROUPS", 2)
    df = spark.range(5000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', cast(id div 2 AS string)) AS text")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.mark_copies(df).collect()}
    groups = defaultdict(list)
    for i in range(5000):
        groups["hot" if i % 3 == 0 else str(i // 2)].append(i)
    assert got == {i: (max(g), len(g)) for g in groups.values() for i in g}


def brute_components(rows, width, percent=80):
    def shingles(t):
        w = words_of(t)
        return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[find(a)].append(i)
    out = []
    for a, (i, s) in enumerate(sets):
        c = min((x for x in least[find(a)] if x is not None), default=None) if s else i
        out.append((i, len(s), c, i == c))
    return Counter(out)


def test_near_copies(docs, rows):
    for width in (2, 5):
        assert Counter(map(tuple, near_dedup.near_copies(docs, width).collect())) == brute_components(rows, width)


def test_near_copies_chains(spark):
    """A ring of texts in which neighbours are linked and others are not, and one common shared passage."""
    rng = np.random.default_rng(3)
    text = [f"v{x}" for x in rng.integers(0, 10**6, 200)]
    rows = [(0, " ".join(text))]
    for i in range(1, 90):
        at = rng.integers(0, 200, 5)
        text = [f"n{i}x{k}" if k in at else w for k, w in enumerate(text)]
        rows.append((i, " ".join(text)))
    rows += [(100 + i, "all of us share this passage of eight words " + " ".join(f"o{i}x{k}" for k in range(30))) for i in range(60)]
    got = near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_components(rows, 2)


def test_link_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP_SETS", 8)
    rows = [(i, " ".join([*(f"b{k}" for k in range(80)), f"only{i}", f"and{i % 7}"])) for i in range(60)]
    got = near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_likelihood_estimates_similarity():
    tool, rng = near_dedup.Sketcher(1), np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        error = []
        for _ in range(20):
            h = rng.integers(0, 2**63, 2000, np.uint64)
            n = int(2000 * share / (1 + share) * 2 / 2)
            a, b = h[:1000], h[1000 - n:2000 - n]
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            est = near_dedup.likely_similarity(tool.registers(a)[None], tool.registers(b)[None], np.array([1000.0]), np.array([1000.0]))[0]
            error.append(est - true)
        assert abs(np.mean(error)) < 0.04 and np.max(np.abs(error)) < 0.2


def brute_repeats(rows, length=50):
    holders = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    big = float("inf")
    for i, b in raws:
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            holders[s] = min(holders.get(s, big), big if i is None else i)
    out = []
    for i, b in raws:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if holders[b[p:p + length]] < (big if i is None else i):
                gone[p:p + length] = True
        gone = gone[:len(b)]
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return Counter(out)


def test_repeats(spark, docs, rows, monkeypatch):
    got = suffix_dedup.remove_repeats(docs).drop("starts", "stops")
    assert Counter(map(tuple, got.collect())) == brute_repeats(rows)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "SLICE", 100)
    rng = np.random.default_rng(1)
    stock = ["".join(map(chr, rng.integers(97, 101, 400))) for _ in range(6)]
    mixed = [(int(i), "".join(stock[k][a:a + n] for k, a, n in zip(rng.integers(0, 6, 5), rng.integers(0, 300, 5), rng.integers(30, 120, 5))) + "ab" * int(i % 40)) for i in rng.permutation(120)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(mixed, "doc_id long, text string"), texts=True)
    assert Counter(map(tuple, got.drop("starts", "stops", "kept").collect())) == brute_repeats(mixed)


def test_repeats_of_short_rows(spark):
    """Rows of 25 to 31 bytes over and over, one letter of a middle one changed: runs of many windows with equal ends."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(160):
        line = bytes(rng.integers(97, 123, 24 + k % 7, np.uint8)).decode() + "\n"
        at = int(rng.integers(len(line) - 1))
        one, two = (line[:at] + c + line[at + 1:] for c in "01")
        rows += [(4 * k, line * 5 + one + line * 5), (4 * k + 1, line * 5 + two + line * 5), (4 * k + 2, f"-{k}-" + line * 2 + two + line * 2 + f"={k}=")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("starts", "stops")
    assert Counter(map(tuple, got.collect())) == brute_repeats(rows)


def test_nothing(nothing):
    assert exact_dedup.mark_copies(nothing).count() == 0
    assert near_dedup.near_copies(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet' WHERE length(text) < 4000")
    small = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000")
    for got, sql in ((exact_dedup.mark_copies(small), exact_dedup.SQL), (near_dedup.near_copies(small), near_dedup.SQL), (suffix_dedup.remove_repeats(small).drop("starts", "stops"), suffix_dedup.SQL)):
        want = con.sql(sql)
        assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())
