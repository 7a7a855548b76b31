"""Quality classifier: an additive model of binned text features with pairwise interactions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import documents, for_python, from_python, settle, settle_python

#: Bytes whose share of a text is a feature.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "space": b" \t\r", "line": b"\n", "stop": b".?", "bang": b"!", "comma": b",;:", "quote": b"\"'`()[]{}",
    "symbol": b"#*$%&<>", "bar": b"|", "other": b"-_/\\+=@^~", "control": bytes(x for x in range(32) if x not in (9, 10, 13)),
    "high": bytes(range(128, 256)),
}
COUNTS = ["log_bytes", "log_words", "word_bytes", "distinct_words", "repeats_before", "distinct_pairs", "capital_words",
          "odd_ends", "short_words", "repeated_lines", "log_line", "squeezed"]
FEATURES = [*CLASSES, *COUNTS]


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(CLASSES)))
    for k, members in enumerate(CLASSES.values()):
        table[list(members), k] = 1
    return table


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text, from the whole text."""
    table, out = _class_table(), np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        size = len(raw)
        if not size:
            continue
        row[:len(CLASSES)] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ table / size
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        n = len(words) or 1
        row[len(CLASSES):] = (
            np.log1p(size), np.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
            len(set(zip(words, words[1:]))) / n, sum(w[:1].isupper() for w in words) / n, sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:?" for w in words) / n,
            sum(len(w) < 4 for w in words) / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(size / (len(lines) or 1)), len(zlib.compress(raw, 1)) / size)
    return out


class AdditiveModel:
    """Logistic score of one lookup table per feature and one per chosen pair of features.

    Tables are learnt by cyclic boosting: round after round each feature in turn gets a shallow tree
    of at most three leaves over its bins, fitted to the gradient and added at a small rate. Pairs
    are ranked by what a two-cut tree over their coarse bins would gain, then boosted likewise.
    """

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 150, pair_rounds: int = 40, pairs: int = 10, rate: float = 0.15, ridge: float = 5.0):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.ridge = bins, coarse, rounds, pair_rounds, pairs, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.intercept = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        cut = lambda k: [np.unique(np.quantile(c, np.arange(1, k) / k)) if len(c) else np.zeros(0) for c in x.T]
        self.edges, self.coarse_edges = cut(self.bins), cut(self.coarse)
        self.tables = np.zeros((x.shape[1], self.bins))
        self.pairs, self.pair_tables = [], np.zeros((0, self.coarse, self.coarse))
        if not 0 < y.sum() < len(y):
            return self
        cells, z = self._cells(x, self.edges), np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for k, c in enumerate(cells):
                step = self.rate * self._tree(*self._sums(z, y, c, self.bins))
                self.tables[k] += step
                z += step[c]
        rough, side = self._cells(x, self.coarse_edges), self.coarse
        both = {(a, b): rough[a] * side + rough[b] for a, b in combinations(range(x.shape[1]), 2)}
        gain = {k: self._square(*(s.reshape(side, side) for s in self._sums(z, y, c, side * side)))[1] for k, c in both.items()}
        self.pairs = sorted(sorted(gain), key=lambda k: -gain[k])[:self.n_pairs]
        self.pair_tables = np.zeros((len(self.pairs), side, side))
        for _ in range(self.pair_rounds):
            for k, pair in enumerate(self.pairs):
                c = both[pair]
                step = self.rate * self._square(*(s.reshape(side, side) for s in self._sums(z, y, c, side * side)))[0]
                self.pair_tables[k] += step
                z += step.ravel()[c]
        return self

    @staticmethod
    def _cells(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    @staticmethod
    def _sums(z, y, cells, n):
        p = 1 / (1 + np.exp(-z))
        return np.bincount(cells, y - p, n), np.bincount(cells, p * (1 - p), n)

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Leaf value per bin of the best tree of two cuts, found one after the other."""
        cuts = [0, len(g)]
        for _ in range(2):
            best = (1e-9, None)
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                    gt, ht = g[a:b].sum(), h[a:b].sum()
                    gain = gl**2 / (hl + self.ridge) + (gt - gl)**2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    k = int(gain.argmax())
                    best = max(best, (float(gain[k]), a + k + 1), key=lambda t: t[0])
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(len(g))
        for a, b in zip(cuts, cuts[1:]):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + self.ridge)
        return out

    def _square(self, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """Leaf value per cell, and gain, of the best tree that cuts both axes once."""
        def quarters(s):
            c = s.cumsum(0).cumsum(1)
            low, top, left = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
            return low, top - low, left - low, c[-1, -1] - top - left + low

        parts = list(zip(quarters(g), quarters(h), strict=True))
        gain = sum(a**2 / (b + self.ridge) for a, b in parts) - g.sum()**2 / (h.sum() + self.ridge)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        v = [a[i, j] / (b[i, j] + self.ridge) for a, b in parts]
        rows, cols = np.arange(len(g))[:, None] <= i, np.arange(len(g))[None] <= j
        return np.where(rows, np.where(cols, v[0], v[1]), np.where(cols, v[2], v[3])), float(gain[i, j])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: a sum of table entries per row, through the logistic curve."""
        z = np.full(len(x), self.intercept)
        for table, c in zip(self.tables, self._cells(x, self.edges), strict=True):
            z += table[c]
        rough = self._cells(x, self.coarse_edges)
        for table, (a, b) in zip(self.pair_tables, self.pairs, strict=True):
            z += table[rough[a], rough[b]]
        return 1 / (1 + np.exp(-z))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: float = 0.3) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score and predicted.

    Features of every whole text are computed once and written. The model learns from a
    share of the labelled rows whose crc32(doc_id) mod 5 is not 0, picked by a hash of doc_id so that
    `sample` are expected, or from all if there are fewer;
    of several labels of a doc_id the largest counts, null labels do not. Inputs are features of the
    text alone. Empty and null texts have all features 0 and are scored like others. Without both
    labels among the learnt rows every score is their smoothed share. A null doc_id is not held out.
    """
    columns = [f"f{i}" for i in range(len(FEATURES))]

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = pd.DataFrame(features(list(part["text"])), columns=columns)
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield out

    measured = settle_python(from_python(for_python(docs).mapInPandas(measure, "doc_id string, " + ", ".join(f"{c} double" for c in columns))), "features")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    usable = settle(measured.where(~held).dropDuplicates(["doc_id"]).join(known, "doc_id"), "labelled")
    share = min(1.0, sample / max(1, usable.count()))
    learnt = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).toPandas().sort_values("doc_id")
    model = AdditiveModel().fit(learnt[columns].to_numpy(), learnt["label"].to_numpy())

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": model.score(part[columns].to_numpy())})

    text_id = measured.withColumn("held_out", held).withColumn("doc_id", F.col("doc_id").cast("string"))
    scored = from_python(text_id.mapInPandas(score, "doc_id string, held_out boolean, score double"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all `documents`, learnt from `labels`."""
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
