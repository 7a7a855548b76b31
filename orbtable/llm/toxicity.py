"""Toxicity: a lexicon trie met by Levenshtein automata finds terms and misspellings; context windows weigh them."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import body, documents, for_python, from_python, settle, worker_memo

#: Marks around and words before a term that is quoted or talked about; words that address someone. Fixed values.
OPENING = "\"'`“„«‹‘‚"
CLOSING = "\"'`”“»›’‘"
REPORTING = frozenset("said says wrote writes called calls quote quoted word words term terms phrase means "
                      "sagte schrieb nannte wort begriff dit écrit appelé mot terme dijo escribió llamó palabra término".split())
ADDRESS = frozenset("you your you're ur du dich dein ihr euch tu toi ton vous votre tú te usted ustedes".split())
#: What a quoted and an addressed term count for, beside 1 for any other, and the words looked at on each side.
QUOTED, ADDRESSED, REACH = 0.25, 1.5, 5
#: Words of the window whose evidence is summed for the densest passage.
PASSAGE = 50
#: Letters of the beginnings that are tried as stems, and the longest whole word that is.
STEMS, LONGEST = range(4, 9), 24
FEATURES = ["evidence", "density", "passage", "terms", "quoted", "ratio", "words", "exact", "misspelt"]


def bare(word: str) -> str:
    """The word in lower case without marks at its ends."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


def edits_for(term: str, whole: bool) -> int:
    """Misspelt letters allowed: one from five letters on (six for a stem), two from nine on for whole words."""
    return (2 if len(term) >= 9 else 1 if len(term) >= 5 else 0) if whole else int(len(term) >= 6)


class LexiconAutomaton:
    """Words within some edits of a term of a lexicon.

    A state is a set of pairs of trie node and edits so far: what the Levenshtein automata of all terms
    reach together with the letters read. Sets become numbers and steps a table as they are first met, so
    a word is read by one lookup a letter. A pair is dropped when no term below its node allows its edits.
    A whole term is found at a word's end, a stem as soon as it is read.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.kids, self.limit, self.ends = [{}], [0], [[]]
        for t, (text, whole) in enumerate(terms):
            node, allowed = 0, edits_for(text, whole)
            self.limit[0] = max(self.limit[0], allowed)
            for c in text:
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.limit.append(0)
                    self.ends.append([])
                node = self.kids[node][c]
                self.limit[node] = max(self.limit[node], allowed)
            self.ends[node].append((t, whole, allowed))
        self.letters = {c for k in self.kids for c in k}
        self.numbers, self.sets, self.steps, self.at_end, self.on_way = {}, [], [], [], []
        self.start = self._number({0: 0} if terms else {})

    def _number(self, pairs: dict[int, int]) -> int:
        todo = list(pairs)
        while todo:  # a letter of the term may be missing from the word
            n = todo.pop()
            for k in self.kids[n].values():
                e = pairs[n] + 1
                if e <= self.limit[k] and e < pairs.get(k, 9):
                    pairs[k] = e
                    todo.append(k)
        key = frozenset(pairs.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
            found = [(e, -len(self.terms[t][0]), t, whole) for n, e in pairs.items() for t, whole, allowed in self.ends[n] if e <= allowed]
            self.at_end.append(min([f[:3] for f in found if f[3]], default=None))
            self.on_way.append(min([f[:3] for f in found if not f[3]], default=None))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for n, e in self.sets[state].items():
            moves = [(k, e + (letter != c)) for letter, k in self.kids[n].items()]
            for k, more in [*moves, (n, e + 1)]:  # the letter itself, another one, or one too many
                if more <= self.limit[k] and more < out.get(k, 9):
                    out[k] = more
        self.steps[state][c] = self._number(out)
        return self.steps[state][c]

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest and then longest term, or None."""
        state, best = self.start, None
        for c in word:
            c = c if c in self.letters else ""
            state = self.steps[state][c] if c in self.steps[state] else self._step(state, c)
            if not self.sets[state]:
                break
            here = self.on_way[state]
            best = here if here and (best is None or here < best) else best
        else:
            here = self.at_end[state]
            best = here if here and (best is None or here < best) else best
        return best and (best[2], best[0])


class Finder(dict):
    """Word as written -> (term, edits) or None; forgets all when full, and remembers no long words."""

    def __init__(self, terms: list[tuple[str, bool]], room: int = 200_000):
        super().__init__()
        self.automaton, self.room = LexiconAutomaton(terms), room

    def __missing__(self, word: str) -> tuple[int, int] | None:
        found = self.automaton.find(bare(word))
        if len(word) <= 40:
            if len(self) >= self.room:
                self.clear()
            self[word] = found
        return found


def finder(terms: list[tuple[str, bool]]) -> Finder:
    """One finder per worker and lexicon."""
    name = "toxicity " + hashlib.sha256(repr(terms).encode()).hexdigest()
    memo = worker_memo("toxicity")
    if name not in memo:
        memo.clear()
        memo[name] = Finder(terms)
    return memo[name]


def stance(words: list[str], i: int) -> float:
    """What a term at `i` counts for: less between quotation marks or after a reporting word, more beside an address."""
    before, after = words[max(0, i - REACH):i + 1], words[i:i + 1 + REACH]
    if any(w[0] in OPENING for w in before) and any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in after if w.rstrip(".,;:!?")):
        return QUOTED
    if any(bare(w) in REPORTING for w in before[:-1][-3:]):
        return QUOTED
    return ADDRESSED if any(bare(w) in ADDRESS for w in [*before[:-1][-3:], *after[1:4]]) else 1.0


def text_features(text: str, found: Finder, weights: np.ndarray, excess: float) -> list[float]:
    """FEATURES of a whole text. `weights` has a row per term and a column per number of edits."""
    words = text.split()
    hits = [(i, h) for i, w in enumerate(words) if (h := found[w])]
    if not hits:
        return [0, 0, 0, 0, 0, -excess * len(words), np.log1p(len(words)), 0, 0]
    places = np.array([i for i, _ in hits])
    plain = np.array([weights[t, e] for _, (t, e) in hits])
    share = np.array([stance(words, i) for i in places.tolist()])
    value = np.maximum(plain * share, 0)
    run = np.concatenate([[0], np.cumsum(value)])
    best = (run[np.searchsorted(places, places + PASSAGE)] - run[:-1]).max()
    edits = np.array([e for _, (_, e) in hits])
    total = value.sum()
    return [np.log1p(total), total / (1 + len(words) / 100), np.log1p(best), np.log1p(len({t for _, (t, _) in hits})),
            np.log1p(np.maximum(plain, 0)[share == QUOTED].sum()), (plain * share).sum() - excess * len(words), np.log1p(len(words)),
            np.log1p((edits == 0).sum()), np.log1p((edits > 0).sum())]


def forms(text: str) -> set[tuple[str, bool]]:
    """Whole words and stems of a text, each once."""
    out = set()
    for w in {bare(w) for w in text.split()}:
        if 2 < len(w) <= LONGEST:
            out.add((w, True))
        out.update((w[:k], False) for k in STEMS if k < len(w))
    return out


def _counted(sample: DataFrame, wanted: set | None, toxic: int) -> DataFrame:
    """(term, whole, n): documents of the sample with that label that hold a form, counted per batch and then summed."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = Counter()
            for text in part["text"]:
                n.update(forms(text) if wanted is None else forms(text) & wanted)
            yield pd.DataFrame([(t, w, c) for (t, w), c in n.items()], columns=["term", "whole", "n"])

    counted = sample.where(F.col("label") == toxic).select("text").mapInPandas(count, "term string, whole boolean, n long")
    return counted.groupBy("term", "whole").agg(F.sum("n").alias("n"))


def choose_terms(toxic: dict, clean: dict, n_toxic: int, n_clean: int, evidence: float, most: int) -> list[tuple[str, bool]]:
    """Forms that mark toxic documents by a log-likelihood ratio test; of a stem and a longer form that occur alike, the longer."""
    def ratio(a: int, b: int) -> float:
        if a * n_clean <= b * n_toxic:
            return 0.0
        n, out = n_toxic + n_clean, 0.0
        for x, rows, column in ((a, n_toxic, a + b), (b, n_clean, a + b), (n_toxic - a, n_toxic, n - a - b), (n_clean - b, n_clean, n - a - b)):
            out += 2 * x * np.log(x * n / (rows * column)) if x else 0.0
        return out

    scored = {f: r for f, a in toxic.items() if (r := ratio(a, clean.get(f, 0))) >= evidence}
    longer = defaultdict(list)
    for text, whole in scored:
        for k in STEMS:
            if k < len(text) or (k == len(text) and whole):
                longer[text[:k], False].append((text, whole))
    alike = lambda f, g: toxic[g] >= 0.95 * toxic[f] and clean.get(g, 0) <= clean.get(f, 0)
    kept = [f for f in scored if not any(alike(f, g) for g in longer[f])]
    return sorted(sorted(kept), key=lambda f: -scored[f])[:most]


class Logistic:
    """Logistic regression on standardised columns with a ridge, by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> Logistic:
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.w = np.zeros(x.shape[1] + 1)
        self.w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        if not 0 < y.sum() < len(y):
            return self
        z, keep = self._wide(x), np.r_[1e-6, np.full(x.shape[1], ridge)]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z @ self.w))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * self.w)
            self.w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        return self

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._wide(x) @ self.w, -500, 500)))


class ToxicityModel:
    """Lexicon, weights of its terms by edits, and the logistic curve over FEATURES."""

    def __init__(self, terms: list[tuple[str, bool]], weights: np.ndarray, excess: float, curve: Logistic | None = None):
        self.terms, self.weights, self.excess, self.curve = terms, weights, excess, curve

    def features(self, texts: Iterable[str]) -> np.ndarray:
        found = finder(self.terms)
        return np.array([text_features(t, found, self.weights, self.excess) for t in texts], float).reshape(-1, len(FEATURES))

    def score(self, texts: Iterable[str]) -> np.ndarray:
        return self.curve.score(self.features(texts))


def _weigh(sample: DataFrame, terms: list[tuple[str, bool]]) -> tuple[np.ndarray, float]:
    """Log ratio of a hit's rates in toxic and clean words, by term and edits, and the excess of all hits per word.

    A misspelling counts as half a hit's weight until the sample says otherwise.
    """
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = finder(terms)
        for part in parts:
            n = Counter()
            for text, label in zip(part["text"], part["label"]):
                words = text.split()
                n[-1, 0, label] += len(words)
                n.update((*h, label) for w in words if (h := found[w]))
            yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["term", "edits", "label", "n"])

    rows = sample.select("text", "label").mapInPandas(count, "term int, edits int, label int, n long").groupBy("term", "edits", "label").agg(F.sum("n").alias("n")).collect()
    n = defaultdict(int, {(r["term"], r["edits"], r["label"]): r["n"] for r in rows})  # three rows a term and label at most
    words = [max(1, n[-1, 0, k]) for k in (0, 1)]
    out = np.zeros((len(terms), 3))
    for t in range(len(terms)):
        for e in range(3):
            prior = np.exp(out[t, 0] / 2) if e else 1.0
            out[t, e] = np.log((n[t, e, 1] + prior * words[1] / words[0]) / words[1]) - np.log((n[t, e, 0] + 1) / words[0])
    rate = [sum(c for (t, _, lab), c in n.items() if t >= 0 and lab == k) / words[k] for k in (0, 1)]
    return out, float(rate[1] - rate[0])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 8_000, candidates: int = 20_000, margin: float = 4.0, most: int = 200) -> ToxicityModel:
    """The model of the labelled rows whose crc32(doc_id) mod 5 is not 0.

    A hash of doc_id picks a share of them so that `sample` are expected, or all if there are fewer; a repeated
    doc_id is one row with its greatest text and largest label. Forms of three toxic documents or more,
    the `candidates` most frequent, are counted in clean ones too; those whose log-likelihood ratio
    exceeds 2 log(forms tried) + `margin`, so that chance brings in none, become terms, `most` at most.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = settle(known, "labels")
    share = min(1.0, sample / max(1, known.count()))
    picked = settle(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))), "picked")
    texts = docs.select("doc_id", body().alias("text")).join(picked, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("label").alias("label"))
    texts = settle(texts.drop("doc_id"), "sample")
    size = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    toxic = _counted(texts, None, 1).where("n >= 3").orderBy(F.desc("n"), "term", "whole").limit(candidates).collect()
    toxic = {(r["term"], r["whole"]): r["n"] for r in toxic}
    clean = {(r["term"], r["whole"]): r["n"] for r in _counted(texts, set(toxic), 0).collect()}
    terms = choose_terms(toxic, clean, size.get(1, 0), size.get(0, 0), 2 * np.log(len(toxic) + 1) + margin, most)
    model = ToxicityModel(terms, *_weigh(texts, terms))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(model.features(part["text"]), columns=FEATURES).assign(label=part["label"].to_numpy())

    rows = texts.mapInPandas(measure, ", ".join(f"{f} double" for f in FEATURES) + ", label int").toPandas().sort_values([*FEATURES, "label"])
    model.curve = Logistic().fit(rows[FEATURES].to_numpy(), rows["label"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8_000, least: float = 0.5) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score and predicted.

    The text alone is scored, whole; see `learn` for what the model is learnt from. Null and empty texts have no
    hits and score like any text without words. Without both labels among the learnt rows every score
    is their smoothed share. Repeated rows repeat; a null doc_id stays null and is not held out.
    """
    model = learn(docs, labels, sample)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": model.score(part["text"])})

    scored = from_python(for_python(docs, held_out().alias("held_out")).mapInPandas(score, "doc_id string, held_out boolean, score double"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all `documents`, learnt from `labels`."""
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
