"""LM scoring: a weighted backoff automaton over words, counted over the whole corpus."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import documents, for_python, settle, worker_memo
from orbtable.llm.exchange import BLOCK_BYTES, answers, ask, block_ids, mix, shards_for, squeeze_ints, swell_ints
from orbtable.llm.wordsplit import Memo

#: Hashes of the end token and of the context before the first word; no word is empty or a space.
END, BEGIN = xxhash.xxh3_64_intdigest(b""), xxhash.xxh3_64_intdigest(b" ")
#: Weight of the failure arc, in counts: a context seen n times backs off with weight SMOOTH / (n + SMOOTH).
SMOOTH = 300.0


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def encode_blocks(docs: DataFrame) -> DataFrame:
    """One row per block: its documents as numbers of the block's own vocabulary of word hashes.

    Numbers go by falling frequency. Every document ends with the end token; repeats of it tell the
    documents apart.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, ids = worker_memo("word_hash"), block_ids()
        hashes = memo.setdefault("memo", Memo(xxhash.xxh3_64_intdigest))
        held: list = []
        tokens: list = []
        size = 0

        def flush():
            flat = np.concatenate(tokens)
            vocab, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return pd.DataFrame([{"block": next(ids), "doc_ids": held, "lengths": squeeze_ints(np.array([len(t) for t in tokens])),
                                  "vocab": vocab[order].tobytes(), "tokens": squeeze_ints(rank[inverse]), "bytes": size}])

        for part in parts:
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass").lower()
                words = raw.split()
                tokens.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                tokens[-1] = np.append(tokens[-1], np.uint64(END))
                held.append(doc_id)
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, tokens, size = [], [], 0
        if tokens:
            yield flush()

    return for_python(docs).mapInPandas(
        run, "block long, doc_ids array<string>, lengths binary, vocab binary, tokens binary, bytes long")


class Block:
    """A block's token stream and, at each token, the state the traversal is in before it."""

    def __init__(self, row):
        self.vocab = np.frombuffer(row["vocab"], "<u8")
        self.tokens = swell_ints(row["tokens"]).astype(np.int64)
        self.lengths = swell_ints(row["lengths"]).astype(np.int64)
        self.ids = [None if pd.isna(x) else int(x) for x in row["doc_ids"]]
        self.held = np.array([is_held_out(x) for x in self.ids], bool)
        self.learnt = np.repeat(~self.held, self.lengths)
        begin = len(self.vocab)  # the state before the first word
        self.states = np.append(begin, self.tokens[:-1])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.states[self.starts] = begin

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' keys in rising order and how often they were learnt."""
        order = np.argsort(self.vocab)
        return self.vocab[order], np.bincount(self.tokens, self.learnt, len(self.vocab)).astype(np.uint64)[order]

    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct (state, word) pairs in rising order, how often learnt, and the pair at each token."""
        pairs, inverse = np.unique(self.states * (len(self.vocab) + 1) + self.tokens, return_inverse=True)
        state, word = np.divmod(pairs, len(self.vocab) + 1)
        keys = mix(np.append(self.vocab, np.uint64(BEGIN))[state], self.vocab[word])
        order = np.argsort(keys, kind="stable")
        keys, merged = np.unique(keys[order], return_inverse=True)
        at = np.empty(len(order), np.int64)
        at[order] = merged
        where = at[inverse]
        return keys, np.bincount(where, self.learnt, len(keys)).astype(np.uint64), where


def score_texts(docs: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The automaton has a state for the empty context, one for the begin of a text and one for each word.
    Learnt pairs are arcs of weight (c(h w) + smooth p(w)) / (c(h) + smooth); a state's failure arc, of
    weight smooth / (c(h) + smooth), leads to the empty context, whose arcs p(w) are the add-one base.
    So each state's weights sum to one with the mass of unknown words. One traversal of each text from
    left to right carries the state. All pairs of all learnt documents are counted; no count is cut.

    The model is nowhere whole: a block of documents asks the corpus for the counts of its own words
    and pairs. A null or empty text is the end token alone; repeated rows are learnt as often as they
    occur; a null doc_id is learnt. Without learnt tokens every token has probability 1.
    """
    blocks = settle(encode_blocks(docs), "blocks")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    shards = shards_for(total)
    sums = "block long, learnt long, texts long"

    def sizes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                lengths = swell_ints(row["lengths"]).astype(np.int64)
                learnt = np.array([pd.isna(x) or not is_held_out(int(x)) for x in row["doc_ids"]], bool)
                yield pd.DataFrame([{"block": row["block"], "learnt": int(lengths[learnt].sum()), "texts": int(learnt.sum())}])

    words = settle(ask(blocks, lambda row: Block(row).words(), "sum", shards), "words")
    arcs = ask(blocks, lambda row: Block(row).arcs()[:2], "sum", shards)
    n, texts = blocks.select("block", "doc_ids", "lengths").mapInPandas(sizes, sums).agg(F.sum("learnt"), F.sum("texts")).first()
    n, texts = n or 0, texts or 0
    v = words.agg(F.sum("fresh")).first()[0] or 0

    def score(group: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([of_block(row) for _, row in group.iterrows()], ignore_index=True)

    def of_block(row) -> pd.DataFrame:
        block = Block(row)
        count = np.empty(len(block.vocab))
        count[np.argsort(block.vocab)] = answers(row["words"])
        base = (count + 1) / (n + v + 1)
        pairs, where = answers(row["arcs"]).astype(np.float64), block.arcs()[2]
        context = np.append(count, texts)
        fail = smooth / (context + smooth)
        p = pairs[where] / (context + smooth)[block.states] + fail[block.states] * base[block.tokens]
        total = lambda x: np.add.reduceat(x, block.starts)
        return pd.DataFrame({
            "doc_id": pd.array(block.ids, "Int64"), "held_out": block.held, "n_tokens": block.lengths,
            "n_known": total((count[block.tokens] > 0).astype(np.int64)), "train_tokens": n,
            "base_score": total(np.log10(base)[block.tokens]), "score": total(np.log10(p))})

    joined = blocks.join(words.select("block", F.col("answer").alias("words")), "block").join(arcs.select("block", F.col("answer").alias("arcs")), "block")
    return joined.mapInPandas(lambda parts: (score(part) for part in parts if len(part)),
                              "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all `documents`."""
    return score_texts(documents(spark, sf_dir))
