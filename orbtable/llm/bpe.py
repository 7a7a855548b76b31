"""BPE encoding and decoding by a tokenization automaton built from the merges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import documents, for_python, from_python, worker_memo
from orbtable.llm.wordsplit import Memo, Splitter


class Automaton:
    """Deterministic automaton whose accepted arc sequences are the right tokenizations.

    It starts as one state with a loop for each base symbol. Each merge (u, v) -> w adds a gadget: arcs
    u now lead to a copy of their state without its arc v, and every state with an arc u gets an arc w
    to where v leads. All arcs of a token share one target, so a state is a token and the number of
    merges its target had been split by; a state's arc set is read through that history and kept in
    a transition table once it was looked at.
    """

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.vocab, self.end = vocab, end
        self.rank: dict[tuple[str, str], int] = {}  # when (u, v) stopped to be a path
        self.made: dict[str, tuple[int, str, str]] = {}  # when w got its arcs, from u and v
        self.arcs: dict[tuple[str, str], bool] = {}
        self.longest = max((len(t.removesuffix(end)) for t in vocab), default=1)
        for i, (u, v) in enumerate(merges):
            self._gadget(i, u, v)

    def _gadget(self, i: int, u: str, v: str) -> None:
        w = u + v
        if w in self.made:
            raise ValueError(f"{w!r} is made by two merges")
        if self._follows(u, v, i - 1):
            self.made[w] = (i, u, v)
        self.rank[u, v] = i

    def _follows(self, token: str, arc: str, when: int) -> bool:
        """Whether the state behind `token`, as of merge `when`, has an arc `arc` (made by `when` or later)."""
        while True:
            if self.rank.get((token, arc), when + 1) <= when:
                return False
            made, origin = self.made.get(arc), self.made.get(token)
            if made and (origin is None or origin[0] < made[0]):
                when, arc = min(when, made[0]), made[1]  # the arc was put beside that of its left half
            elif origin:
                when, token = origin[0] - 1, origin[2]  # it shares the state that the right half had before
            else:
                return True

    def follows(self, token: str, arc: str) -> bool:
        out = self.arcs.get((token, arc))
        if out is None:
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            out = self.arcs[token, arc] = self._follows(token, arc, len(self.rank))
        return out

    def encode(self, word: str) -> list[str]:
        """Arc labels of the one accepted path over `word`, which is not empty."""
        n, vocab, made, follows = len(word), self.vocab, self.made, self.follows
        whole = word + self.end
        last: list = [None] * (n + 1)
        for stop in range(1, n + 1):
            for start in range(max(0, stop - self.longest), stop):
                if start and last[start] is None:
                    continue
                arc = word[start:stop] if stop < n else whole[start:]
                if arc not in vocab or stop - start > 1 and arc not in made:
                    continue
                if not start or follows(last[start], arc):
                    last[stop] = arc
                    break
            else:
                raise ValueError(f"no path over {word[:stop]!r}")
        out = []
        while n:
            out.append(last[n])
            n -= len(out[-1].removesuffix(self.end) if n == len(word) else out[-1])
        return out[::-1]


class Encoder:
    """Texts to ids and back, with memos of chunks and pieces."""

    def __init__(self, path: str):
        self.split = Splitter(path)
        model = self.split.spec["model"]
        self.vocab = model["vocab"]
        merges = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        self.machine = Automaton(self.vocab, merges, model["end_of_word_suffix"] or "")
        self.pieces = Memo(self.machine.encode)
        self.chunks = Memo(self._chunk)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        if chunk in self.split.specials:
            ids, arcs = [self.split.specials[chunk]], [chunk]
        else:
            arcs = [a for p in self.split.pieces(chunk) for a in self.pieces[p]]
            ids = [self.vocab[a] for a in arcs]
        return np.array(ids, "<u4").tobytes(), " ".join(arcs)

    def __call__(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and the decoded text: arc labels joined by a space."""
        got = list(map(self.chunks.__getitem__, self.split.chunks(text)))
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got])


def encoder(path: str) -> Encoder:
    """The worker's encoder for `path`, built once."""
    kept = worker_memo("bpe")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers as binary), decoded text of every row of `docs`.

    A null text counts as empty and gives no ids and an empty decoded text; repeated rows repeat; a
    null doc_id stays null. Memos are bounded, so memory does not grow with the table.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(path)
        for part in parts:
            got = [code(t) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [g[0] for g in got], "decoded": [g[1] for g in got]})

    return from_python(for_python(docs).mapInPandas(run, "doc_id string, ids binary, decoded string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, sha = encoder(path), lambda b: hashlib.sha256(b).hexdigest()
        for part in parts:
            rows = []
            for text in part["text"]:
                ids, decoded = code(text)
                rows.append((len(ids) // 4, sha(ids), sha(decoded.encode("utf-8"))))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield out

    return from_python(for_python(docs).mapInPandas(
        run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of `documents`, as digests."""
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
