"""Packing along a space-filling curve: similar documents become neighbours and fill sequences."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import BATCH, documents, for_python, from_python, settle_python, worker_memo
from orbtable.llm.wordsplit import Memo, Splitter

DIMS, BITS = 4, 10


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of `cells` (n x dims, `bits` bits each) along the Hilbert curve.

    Works from the top bit down: a set bit inverts the lower bits of the first axis, a clear one
    exchanges them with the axis's own; a Gray decoding over axes and bits follows.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[dims - 1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> level & 1
    return key


def signs(n: int, dims: int = DIMS) -> np.ndarray:
    """Fixed random signs of `n` hashed features in `dims` projections."""
    z = np.arange(n * dims, dtype=np.uint64).reshape(n, dims) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB) >> np.uint64(63)).astype(np.float32) * 2 - 1


class WordIds:
    """Ids of a tokenizer of the word-end kind, by the library's own model for pieces not yet seen.

    A piece of small ASCII letters is a chunk of its own with the same ids, and is kept as such, once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.split, model = Splitter(path), Tokenizer.from_file(path)
        self.size = model.get_vocab_size()
        self._model = model.model.tokenize
        self.pieces, self.chunks = Memo(self._ids), Memo(self._chunk)

    def _ids(self, piece: str) -> bytes:
        got = [t.id for t in self._model(piece)]
        return struct.pack(f"<{len(got)}I", *got)

    def _chunk(self, chunk: str) -> bytes:
        if chunk in self.split.specials:
            return np.array([self.split.specials[chunk]], "<u4").tobytes()
        if chunk.isascii() and chunk.isalpha():
            low = chunk.lower()
            return self._ids(chunk) if low == chunk else self.chunks[low]
        plain = lambda p: p.isascii() and p.isalpha() and p not in self.split.specials
        return b"".join([(self.chunks if plain(p) else self.pieces)[p] for p in self.split.pieces(chunk)])

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, self.split.chunks(text))), "<u4")


    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text. Each distinct run between ASCII white space is looked up once for all texts."""
        runs = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = runs.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        ids = [self._run(r) if known is None else known for r, known in zip(distinct, map(self.chunks.get, distinct), strict=True)]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, codes = np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
        take = n[codes]
        end = np.concatenate([[0], np.cumsum(take)])
        out = flat[np.arange(end[-1]) + np.repeat((np.cumsum(n) - n)[codes] - end[:-1], take)]
        cuts = end[runs.offsets.to_numpy()]
        return (out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def _run(self, run: str) -> bytes:
        # other white space and special strings cut a run further
        return self.chunks[run] if run.isalnum() else b"".join(map(self.chunks.__getitem__, self.split.chunks(run)))


def word_ids(path: str) -> WordIds:
    kept = worker_memo("word_ids")
    if path not in kept:
        kept[path] = WordIds(path)
        kept[path].signs = np.ascontiguousarray(signs(kept[path].size).T.astype(np.int8))
    return kept[path]


def place(vectors: np.ndarray) -> np.ndarray:
    """Curve position of projected vectors: their direction, cut into 2**BITS cells per axis."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    return hilbert_key(np.minimum((unit + 1) * (1 << BITS - 1), (1 << BITS) - 1).astype(np.int64), BITS)


def curve(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id (a string), key, n and ids (16 bits each where the vocabulary allows, else 32) of every row."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = word_ids(path)
        kind = "<u2" if code.size <= 1 << 16 else "<u4"
        for part in parts:
            ids, vectors = [], np.zeros((len(part), DIMS), np.float32)
            for i, got in enumerate(code.many(pa.array(part["text"], pa.large_string()))):
                vectors[i] = code.signs.take(got, axis=1).sum(axis=1)
                ids.append(np.append(got, end_id).astype(kind))
            yield pd.DataFrame({"doc_id": part["doc_id"], "key": place(vectors), "n": [len(x) for x in ids],
                                "wide": kind == "<u4", "ids": [x.tobytes() for x in ids]})

    return for_python(docs).mapInPandas(run, "doc_id string, key long, n long, wide boolean, ids binary")


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all `docs`, dealt gapless over sequences of `length` tokens.

    Returns doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset. The
    documents' token vectors are projected by fixed random signs to four dimensions, and their
    directions sorted by range along the Hilbert curve; ties go by doc_id and a print of the ids, so
    a large group of copies spreads over ranges. The stream of all documents in that order is cut
    every `length` tokens, so only the very last sequence is padded. Every row of `docs` is a
    document, repeated rows too; null or empty texts consist of `end_id`. An empty table gives none.
    """
    coded = settle_python(curve(docs, path, end_id), "curve")
    sorted_ = coded.withColumn("tie", F.xxhash64("ids")).repartitionByRange("key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie")

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, share = 0, TaskContext.get().partitionId()
        for part in parts:
            n = part["n"].to_numpy()
            begin = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pd.DataFrame({"share": share, "begin": begin, "doc_id": part["doc_id"], "n": n, "wide": part["wide"], "ids": part["ids"]})

    ranged = settle_python(sorted_.select("doc_id", "n", "wide", "ids").mapInPandas(local, "share int, begin long, doc_id string, n long, wide boolean, ids binary"), "ranged")
    # one row per range: where it begins in the whole stream
    totals = sorted((r["share"], r["t"]) for r in ranged.groupBy("share").agg(F.sum("n").alias("t")).collect())
    base, at = {}, 0
    for share, total in totals:
        base[share], at = at, at + total

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole[i:i + BATCH] for whole in parts for i in range(0, len(whole), BATCH)):
            out = []
            for share, begin, doc_id, n, wide, ids in zip(*(part[c] for c in ("share", "begin", "doc_id", "n", "wide", "ids")), strict=True):
                tokens, at = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4"), base[share] + begin
                here = 0
                while here < n:
                    take = min(n - here, length - (at + here) % length)
                    out.append((doc_id, here, take, tokens[here:here + take].tobytes(), n, (at + here) // length, (at + here) % length))
                    here += take
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return from_python(ranged.mapInPandas(cut, "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"))


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return with_digest(pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
