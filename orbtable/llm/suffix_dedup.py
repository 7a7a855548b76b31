"""Suffix-array dedup: bytes of strings that a document with a smaller id also holds are removed.

The work is bucket-pointer refinement over the suffixes of all documents, as far as `length` bytes.
A bucket is a hash of the first q bytes of a suffix. Buckets of 8 bytes are refined to 16, 32 and
`length` by pairing a suffix's bucket with the bucket of the suffix that starts later, so each level
reuses the last. Only suffixes whose bucket also holds a document with a smaller id go on:

1. Of all windows of `length` bytes that share their least 20-byte bucket (a run of neighbours, about
   16 of them) one entry asks who holds that bucket. Equal windows have equal least buckets, so a run
   whose bucket no other document holds is done.
2. A surviving run asks for itself as a whole; equal runs are decided at once.
3. Runs that a smaller document may hold in part name their least bucket, and all holders of it that
   are not decided ask window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import documents, for_python, settle
from orbtable.llm.exchange import BLOCK_BYTES, NOBODY, answers, ask, beside, block_ids, mix, shards_for, squeeze, squeeze_ints, swell, swell_ints

CORE = 20
#: Windows hashed at a time: short texts together, so that each is not a call of its own, and a very long one in
#: parts, so that it needs no more memory.
SLICE = 1 << 18


def rank_of(ids: list) -> np.ndarray:
    """doc_ids as unsigned numbers of the same order; null is the largest."""
    return np.array([2**64 - 1 if x is None else int(x) + 2**63 for x in ids], np.uint64)


def refine(buckets: np.ndarray, have: int, want: int) -> np.ndarray:
    """Buckets of `want` bytes from those of `have`, want <= 2 * have."""
    step = want - have
    return mix(buckets[:len(buckets) - step], buckets[step:])


def buckets_of(raw, a: int, windows: int, length: int, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Buckets of `sizes` bytes of the suffixes from `a` that the windows of `length` bytes touch."""
    part = bytes(raw[a:a + windows + length - 1])
    level, have, out = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,)).copy(), 8, {}
    for want in sorted({*sizes, *(q for q in (16, 32) if q < max(sizes))}):
        if want <= 2 * have:
            got = refine(level, have, want)
        else:
            raise ValueError("sizes must at most double")
        out[want] = got
        if want in (16, 32):
            level, have = got, want
    return [out[s] for s in sizes]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each `width` neighbours."""
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:len(values) - k], values[k:])
        k *= 2
    return np.minimum(values[:len(values) - (width - k)], values[width - k:]) if k < width else values


def parts_of(sizes: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Texts one after the other, in parts to hash at once: first text, last but one, first window and windows.

    Short texts come together and with all windows that begin before the last `length` - 1 bytes, also those that
    reach into the next text; a text of more than SLICE bytes comes alone, SLICE windows at a time.
    """
    i, ends = 0, np.append(0, np.cumsum(sizes))
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, side="right")) - 1)
        total = int(ends[j] - ends[i]) - length + 1
        step = SLICE if j == i + 1 else max(1, total)
        for a in range(0, max(0, total), step):
            yield i, j, a, min(step, total - a)
        i = j


def runs_of(raw, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, first window, number of windows and core bucket of each run of documents one after the other."""
    begin = np.cumsum(sizes) - sizes
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    for i, j, a, n in parts_of(sizes, length):
        m = least(buckets_of(raw, int(begin[i]) + a, n, length, (CORE,))[0], length - CORE + 1)
        # windows of a document lie between `low` and `high`, those after them reach into the next one
        low = np.maximum(begin[i:j] - begin[i] - a, 0)
        high = np.minimum(begin[i:j] - begin[i] + sizes[i:j] - length + 1 - a, n)
        some = high > low
        doc, low, high = np.flatnonzero(some) + i, low[some], high[some]
        new = np.append(True, m[1:] != m[:-1])
        new[low] = True
        gaps = np.append(low, n) - np.append(0, high)
        new &= np.repeat(np.arange(2 * len(doc) + 1) % 2 > 0, np.append(np.stack([gaps[:-1], high - low], 1).ravel(), gaps[-1]))
        start = np.flatnonzero(new)
        of = np.searchsorted(low, start, side="right") - 1
        stop = np.minimum(np.append(start[1:], n), high[of])
        out.append((doc[of], start + a - (begin[doc[of]] - begin[i]), stop - start, m[start]))
    return tuple(np.concatenate(c) for c in zip(*out))


def byte_blocks(docs: DataFrame) -> DataFrame:
    """One row per block: doc_ids, lengths in bytes, and the texts' bytes packed."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held, raws, size = block_ids(), [], [], 0

        def flush():
            return pd.DataFrame([{"block": next(ids), "doc_ids": held, "lengths": squeeze_ints(np.array([len(r) for r in raws])), "body": squeeze(b"".join(raws)), "bytes": size}])

        for part in parts:
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                raws.append(text.encode("utf-8", "surrogatepass"))
                held.append(doc_id)
                size += len(raws[-1])
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, raws, size = [], [], 0
        if raws:
            yield flush()

    return for_python(docs).mapInPandas(run, "block long, doc_ids array<string>, lengths binary, body binary, bytes long")


def texts_of(row) -> Iterator[tuple[object, memoryview]]:
    """(doc_id, bytes) of a block's documents."""
    raw, at = memoryview(swell(row["body"])), 0
    for doc_id, n in zip(row["doc_ids"], swell_ints(row["lengths"]).astype(np.int64).tolist(), strict=True):
        yield (None if pd.isna(doc_id) else int(doc_id)), raw[at:at + n]
        at += n


def smallest(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order with the least rank of each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[at], np.minimum.reduceat(ranks[order], at) if len(at) else ranks[order]


class Runs:
    """All runs of a block: document number, first window, windows and core bucket."""

    def __init__(self, row, length: int):
        sizes = swell_ints(row["lengths"]).astype(np.int64)
        self.ranks = rank_of([None if pd.isna(x) else x for x in row["doc_ids"]])
        self.doc, self.first, self.number, self.core = runs_of(memoryview(swell(row["body"])), sizes, length)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        return smallest(self.core, self.ranks[self.doc])

    def held(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per run whether another, and whether a smaller document holds its core."""
        keys, low = self.asked()
        _, high = smallest(self.core, ~self.ranks[self.doc])
        at, own = np.searchsorted(keys, self.core), self.ranks[self.doc]
        smaller = np.minimum(known, low)[at] < own
        return smaller | (known != NOBODY)[at] | (~high[at] > own), smaller


def survivors(row, length: int) -> dict:
    """The runs whose core another document holds, neighbours joined to regions with their bytes."""
    runs = Runs(row, length)
    on, smaller = runs.held(answers(row["answer"])) if len(runs.core) else (np.zeros(0, bool), np.zeros(0, bool))
    doc, first, number = runs.doc[on], runs.first[on], runs.number[on]
    new = np.append(True, (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + number[:-1]))[:len(doc)]
    at = np.flatnonzero(new)
    windows = np.add.reduceat(number, at) if len(at) else number
    raws = [raw for _, raw in texts_of(row)]
    bytes_ = b"".join(bytes(raws[d][a:a + n + length - 1]) for d, a, n in zip(doc[at], first[at], windows))
    return {"block": row["block"], "doc": squeeze_ints(doc[at]), "first": squeeze_ints(first[at]), "windows": squeeze_ints(windows),
            "runs": squeeze_ints(np.diff(np.append(at, len(doc)))), "number": squeeze_ints(number), "smaller": squeeze_ints(smaller[on]),
            "core": runs.core[on].tobytes(), "rank": squeeze_ints(runs.ranks[doc[at]]), "body": squeeze(bytes_)}


REGIONS = ("block long, doc binary, first binary, windows binary, runs binary, number binary, smaller binary, "
           "core binary, rank binary, body binary")


class Regions:
    """What survived of a block; `window` has the bucket of every window left."""

    def __init__(self, row, length: int):
        self.doc, self.first, self.windows, self.runs, self.number, smaller = (
            swell_ints(row[c]).astype(np.int64) for c in ("doc", "first", "windows", "runs", "number", "smaller"))
        self.smaller, self.core, self.rank = smaller > 0, np.frombuffer(row["core"], "<u8"), swell_ints(row["rank"])
        raw, sizes, out = memoryview(swell(row["body"])), self.windows + length - 1, []
        begin = np.cumsum(sizes) - sizes
        for i, j, a, n in parts_of(sizes, length):
            got = buckets_of(raw, int(begin[i]) + a, n, length, (length,))[0]
            if j > i + 1:  # without the windows that reach into the next region
                got = got[np.repeat(np.arange(2 * (j - i)) % 2 == 0, np.stack([self.windows[i:j], np.full(j - i, length - 1)], 1).ravel())[:n]]
            out.append(got)
        self.window = np.concatenate(out) if out else np.zeros(0, np.uint64)
        ends = np.cumsum(self.number)
        begin = ends - self.number
        self.run_key = mix(mix(self.window[begin], self.window[ends - 1]), self.number.astype(np.uint64))
        # nothing bounds a run of repetitive text; beyond the reach of its end windows, windows `length` apart count too
        far = np.flatnonzero(self.number > length + 1)
        more = (self.number[far] - 1) // length
        at = np.cumsum(more) - more
        place = np.arange(more.sum()) - np.repeat(at, more) + 1
        between = mix(self.window[np.repeat(begin[far], more) + place * length], place.astype(np.uint64))
        self.run_key[far] = mix(self.run_key[far], np.add.reduceat(between, at) if len(at) else between)
        self.run_rank = np.repeat(self.rank, self.runs)

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return smallest(self.run_key, self.run_rank)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys

    def whole(self, known: np.ndarray) -> np.ndarray:
        """Runs that a smaller document holds as they are."""
        return known[np.searchsorted(self.keys[0], self.run_key)] < self.run_rank if len(known) else np.zeros(0, bool)

    def asked_cores(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cores, with 1 where a run is open that a smaller document may hold in part."""
        keys, least_ = smallest(self.core, 1 - (self.smaller & ~self.whole(known)).astype(np.uint64))
        return keys, 1 - least_

    def open(self, known: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Windows that must be looked up. The smallest holder of a window is never in a decided run."""
        needed = need[np.searchsorted(self.asked_cores(known)[0], self.core)] > 0 if len(need) else np.zeros(0, bool)
        return np.repeat(needed & ~self.whole(known), self.number)

    def asked_windows(self, known: np.ndarray, need: np.ndarray, on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        on = self.open(known, need) if on is None else on
        return smallest(self.window[on], np.repeat(self.run_rank, self.number)[on])

    def found(self, known: np.ndarray, need: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Per window whether a smaller document holds it."""
        on, out = self.open(known, need), np.repeat(self.whole(known), self.number)
        keys, _ = self.asked_windows(known, need, on)
        if len(keys):
            out[on] = single[np.searchsorted(keys, self.window[on])] < np.repeat(self.run_rank, self.number)[on]
        return out


def spans_of(row, length: int) -> dict:
    """Removed byte ranges of a block: document number, start and end, in order and not touching."""
    regions = Regions(row, length)
    hit = np.flatnonzero(regions.found(answers(row["whole"]), answers(row["need"]), answers(row["single"])))
    begin = np.cumsum(regions.windows) - regions.windows
    of = np.searchsorted(begin, hit, side="right") - 1
    doc, start = regions.doc[of], regions.first[of] + hit - begin[of]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length))[:len(doc)]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return {"block": row["block"], "span_doc": squeeze_ints(doc[at]), "start": squeeze_ints(start[at]), "stop": squeeze_ints(start[last] + length)}


def remove_repeats(docs: DataFrame, length: int = 50, texts: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, stops (and kept with `texts`).

    A byte goes if a `length`-byte string over it (UTF-8, inside the document) also starts in a document
    with a smaller doc_id; strings are judged on the input. Rows with one doc_id do not remove from
    each other; a null doc_id counts as the largest, so such rows lose to all numbers and not to each
    other. Null and empty texts, and those shorter than `length`, lose nothing. `length` lies in 33..64.
    """
    if not 32 < length <= 64:
        raise ValueError("length must lie in 33..64")
    blocks = beside(byte_blocks(docs), "byte_blocks")
    shards = shards_for(blocks.agg(F.sum("bytes")).first()[0] or 0)
    each = lambda make, schema: lambda df: df.mapInPandas(
        lambda parts: (pd.DataFrame([make(row)]) for part in parts for _, row in part.iterrows()), schema)
    cores = ask(blocks, lambda row: Runs(row, length).asked(), "others", shards)
    kept = blocks.join(cores.select("block", "answer"), "block", "left")
    regions = beside(each(lambda row: survivors(row, length), REGIONS)(kept), "regions")
    name = lambda df, column: df.select("block", F.col("answer").alias(column))
    whole = settle(name(ask(regions, lambda row: Regions(row, length).asked(), "min", shards, 8), "whole"), "whole")
    one = regions.join(whole, "block", "left")
    need = settle(name(ask(one, lambda row: Regions(row, length).asked_cores(answers(row["whole"])), "sum", shards), "need"), "need")
    two = one.join(need, "block", "left")
    single = name(ask(two, lambda row: Regions(row, length).asked_windows(answers(row["whole"]), answers(row["need"])), "min", shards, 8), "single")
    spans = each(lambda row: spans_of(row, length), "block long, span_doc binary, start binary, stop binary")(two.join(single, "block", "left"))

    def cut(row) -> pd.DataFrame:
        parts = [swell_ints(row[c]).astype(np.int64) if row[c] is not None else np.zeros(0, np.int64) for c in ("span_doc", "start", "stop")]
        rows = []
        for i, (doc_id, raw) in enumerate(texts_of(row)):
            a, b = np.searchsorted(parts[0], [i, i + 1])
            starts, stops = parts[1][a:b], parts[2][a:b]
            left = b"".join(raw[x:y] for x, y in zip(np.append(0, stops), np.append(starts, len(raw))))
            rows.append((doc_id, len(raw), len(raw) - len(left), len(starts), hashlib.sha256(left).hexdigest(), starts, stops, left if texts else None))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops", "kept"])
        return out.astype({"doc_id": "Int64"})

    out = blocks.join(spans, "block", "left").mapInPandas(
        lambda parts: (cut(row) for part in parts for _, row in part.iterrows()),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>, kept binary")
    return out if texts else out.drop("kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes in all `documents`."""
    return remove_repeats(documents(spark, sf_dir)).drop("starts", "stops")


SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, hex(b[p:p + 49]) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS p FROM d)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hit),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (i <> prev + 1 OR prev IS NULL) AS n_spans
         FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM gone) GROUP BY doc_id),
left_over AS (SELECT a.doc_id, string_agg(hex(a.c), '' ORDER BY a.i) AS h
              FROM (SELECT doc_id, i, b[i:i] AS c FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS i FROM d)) a
              ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(l.h, ''))) AS kept_sha256
FROM d LEFT JOIN runs r USING (doc_id) LEFT JOIN left_over l USING (doc_id)
"""
