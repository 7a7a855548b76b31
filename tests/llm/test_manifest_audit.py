"""Filter audit, manifest and toxicity against brute force and held-out labels."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbtable.llm import filter_audit, manifest, toxicity

SF = "/root/testdata/sf0.001"
words_of = lambda text: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_audit(rows, labels):
    """rows: (doc_id, lang, text); labels: (doc_id, quality, toxic)."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = defaultdict(list)
    for i, lang, t in rows:
        w, t = words_of(t), t or ""
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        docs[lang or ""].append((fails, i in good, i in toxic))
    out, orders = {}, ["".join(p) for p in permutations("ABCDE")]
    for part, members in docs.items():
        total = Counter()
        for order in orders:
            left = members
            for k, x in enumerate(order):
                gone = [m for m in left if m[0][x]]
                earlier = [m for m in members if m[0][x] and m not in left]
                redundant = sum(m[0][x] for m in members) - len(gone)
                assert redundant >= len(earlier)
                left = [m for m in left if not m[0][x]]
                out[part, order, k + 1] = [len(left), len(gone), redundant, sum(m[0][x] and sum(m[0].values()) == 1 for m in members),
                                           sum(m[1] for m in gone), sum(m[2] for m in gone)]
                total[x] += len(gone)
        for order in orders:
            for k, x in enumerate(order):
                out[part, order, k + 1].append(total[x])
    return out


def audited(df):
    return {tuple(r)[:3]: list(r)[3:] for r in df.collect()}


def test_audit(spark, docs, rows):
    langs = ["en", None, "", "fr"]
    known = [(1, 1, 0), (1, 0, 1), (2, None, None), (4, 1, 1), (10, 1, 0), (None, 1, 1), (11, 0, 1), (999, 1, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    table = [(i, langs[k % 4], t) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(table, "doc_id long, lang string, text string").withColumn("part", F.lit("own")).withColumn("bits", F.lit(1)).withColumn("print", F.lit(3))
    got = filter_audit.audit(df, labels)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "int"] + ["bigint"] * 7
    assert audited(got) == brute_audit(table, known)
    assert filter_audit.audit(df.limit(0), labels.limit(0)).count() == 0


def test_audit_of_hot_texts(spark, monkeypatch):
    """A third of the rows share a text and are dealt to several parts; a full filter changes nothing."""
    monkeypatch.setattr(filter_audit, "HOT_GROUPS", 2)
    monkeypatch.setattr(filter_audit, "FILTER_BITS", 64)
    df = spark.range(6000).selectExpr("id AS doc_id", "'en' AS lang", "if(id % 3 = 0, 'hot', concat('t', id div 2)) AS text")
    table = [tuple(r) for r in df.select("doc_id", "lang", "text").collect()]
    keyed = df.select("doc_id", F.col("lang").alias("part"), "text").withColumn("print", F.xxhash64("text"))
    got = {r["doc_id"] for r in filter_audit.later_copies(keyed.drop("text"), keyed).collect()}
    least = {}
    for i, _, t in table:
        least[t] = min(least.get(t, i), i)
    assert got == {i for i, _, t in table if least[t] < i}


def brute_manifest(rows, names):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*[field(text if c == "text" else r[names.index(c)]) for c in manifest.FIELDS])
    at = {c: names.index(c) for c in ("doc_id", "lang", "text")}
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def climb(hashes):
        """top and for each node its (left, right) per level."""
        sides, where, now = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
        while len(now) > 1:
            for n, p in enumerate(where):
                run = now[p // 8 * 8:p // 8 * 8 + 8]
                sides[n].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
            now, where = [h(*now[k:k + 8]) for k in range(0, len(now), 8)], [p // 8 for p in where]
        return now[0], sides

    groups = defaultdict(list)
    for r in rows:
        groups[r[at["lang"]]].append((r[at["doc_id"]], leaf(r, r[at["text"]]), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [climb([x[1] for x in groups[g]]) for g in order]
    if not trees:
        return Counter()
    root, upper = climb([t[0] for t in trees])
    out = Counter()
    for g, (sub, sides), more in zip(order, trees, upper):
        for (i, own, r), path in zip(groups[g], sides):
            path = path + more
            hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
            now = leaf(r, lower(r[at["text"]])) if hit else own
            for a, b in path:
                now = h(a, now, b)
            out[i, own, sub, root, h(*[x for s in path for x in s]), now, now == root] += 1
    return out


def test_manifest(spark, rows):
    """Nulls, negative and huge ids, ids of several rows, repeated rows and langs of one row and of many levels."""
    table = [(i, t, [None, "en", "é", "zz", ""][k % 5], f"s{k % 3}", k if k % 4 else None) for k, (i, t) in enumerate(rows)]
    table += [(k * 7 - 300, f"Text {k}", "en", None, k) for k in range(200)] + [(-2**63, "Low", "en", "s", 1), (2**63 - 1, "High", "en", "s", 1)]
    table += [(5, f"Several {k}", "en", None, 1) for k in range(11)] + [(None, f"None {k}", "zz", None, 1) for k in range(9)] + [(63, "Twice", "en", "s", 1)] * 3
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit("own")).withColumn("path", F.lit(1))
    got = Counter(map(tuple, manifest.check_tampering(df.repartition(5)).collect()))
    assert got == brute_manifest(table, names)
    assert manifest.check_tampering(df.limit(0)).count() == 0
    one = df.where("doc_id = 3")
    assert Counter(map(tuple, manifest.check_tampering(one).collect())) == brute_manifest([r for r in table if r[0] == 3], names)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def brute_find(terms, word):
    """Closest, then longest, then first term within its edits; a stem may end anywhere in the word."""
    best = None
    for t, (text, whole) in enumerate(terms):
        allowed = toxicity.edits_for(text, whole)
        d = edits(text, word)[-1] if whole else min(edits(text, word[:k])[-1] for k in range(1, len(word) + 1)) if word else 99
        if d <= allowed and (best is None or (d, -len(text), t) < best):
            best = (d, -len(text), t)
    return best and (best[2], best[0])


def test_automaton_against_edit_distance():
    terms = [("idiot", True), ("pathetic", True), ("worthless", True), ("réeuxo", False), ("scum", True), ("idiots", True), ("abcd", False), ("disgusting", True)]
    rng, auto = np.random.default_rng(3), toxicity.LexiconAutomaton(terms)
    words = {"", "x", "idiot", "idoit", "idit", "idi0t", "scun", "worthles", "wrthles", "disgustng", "réeuxoan", "réexoan", "abcdef", "abcf"}
    for text, _ in terms:
        for _ in range(300):
            w = list(text) + (list("an") if rng.random() < 0.4 else [])
            for _ in range(rng.integers(0, 4)):
                k, c = int(rng.integers(0, len(w) + 1)), "abdeiostuxz"[int(rng.integers(0, 11))]
                w[k:k + int(rng.integers(0, 2))] = [c] if rng.random() < 0.7 else []
            words.add("".join(w))
    for w in sorted(words):
        assert auto.find(w) == brute_find(terms, w), w
    assert toxicity.LexiconAutomaton([]).find("idiot") is None


def test_quotation_counts_less():
    """The same term counts for a quarter when quoted or reported, and for more beside an address."""
    at = lambda text, term="idiot": toxicity.stance(text.split(), next(i for i, w in enumerate(text.split()) if term in w))
    assert at("He is an idiot and that is all") == 1.0
    assert at('The label "idiot" was dropped') == toxicity.QUOTED
    assert at("a clerk called an idiot by the paper") == toxicity.QUOTED
    assert at("what an idiot you are") == toxicity.ADDRESSED
    weights, found = np.full((1, 3), 4.0), toxicity.Finder([("idiot", True)])
    score = lambda t: toxicity.text_features(t, found, weights, 0.0)[0]
    assert score("you idi0t") > score("an idiot") > score('the word "idiot"') > score("no such thing") == 0


def toxic_tables(spark, n=400):
    rng = np.random.default_rng(1)
    plain = ["".join("bcdfghjklmnpr"[x] + "aeiou"[y] for x, y in zip(rng.integers(0, 13, 3), rng.integers(0, 5, 3))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        w = [plain[k] for k in rng.integers(0, 200, 40)]
        if i % 5 == 0:
            for k in rng.integers(0, 40, 3):
                w[k] = ["vexquog", "zzorthwex", "wyxquist"][int(rng.integers(0, 3))]
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    misspelt = [(n + k, " ".join(plain[:30] + ["vexqoog", "zzorthwxx", "wyxkuist", "vexqug"])) for k in range(5)]
    clean = [(n + 10 + k, " ".join(plain[k:k + 30])) for k in range(5)]
    return (spark.createDataFrame(docs + misspelt + clean, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), n)


def test_toxicity_held_out(spark):
    docs, labels, n = toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs.repartition(3), labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r["predicted"] == int(i % 5 == 0) for i, r in got.items() if r["held_out"] and i < n)
    assert [got[n + k]["predicted"] for k in range(5)] == [1] * 5 and [got[n + 10 + k]["predicted"] for k in range(5)] == [0] * 5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    # labels of held-out rows don't matter
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, turned).collect()}
    assert again == pytest.approx({i: r["score"] for i, r in got.items()})


def test_toxicity_edges(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (None, 1), (11, 0), (11, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "boolean", "double", "int"]
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, _ in rows)
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    assert len({round(r["score"], 9) for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()}) == 1
