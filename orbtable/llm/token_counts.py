"""Token counts through a digest cache: only texts that no one has counted yet are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import attach_groups, body, documents, row_print, settle, worker_memo
from orbtable.llm.wordsplit import Memo
from orbtable.session import scratch_path

CACHE = "tokenizer string, digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
        return hashlib.sha256(f.read() + library.encode()).hexdigest()


class PieceCounter:
    """Counts of a sentencepiece model without begin and end.

    No piece goes on past a space, so the parts between single spaces are counted alone and remembered.
    Texts with other runs or signs of space go to the library whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.apart = not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(n))
        # the parts are alone only where the normalizer leaves all texts as they are
        self.apart &= all(self.model.encode(f"a{c}b", out_type=str)[0][:2] == "▁a" and
                          self.model.decode(self.model.encode(f"a{c}b")) == f"a{c}b" for c in "\xa0　 ﬁＡ\t\n\r\xad​﻿")
        self.parts = Memo(lambda part: len(self.model.encode(part)))

    def __call__(self, text: str) -> int:
        if not self.apart or "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
            return len(self.model.encode(text))
        return sum(map(self.parts.__getitem__, text.split(" "))) if text else 0


class JsonCounter:
    """Counts of a tokenizer file of the tokenizers library, without truncation."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def __call__(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)


def counter(path: str):
    kept = worker_memo("counters")
    if path not in kept:
        kept[path] = (JsonCounter if path.endswith(".json") else PieceCounter)(path)
    return kept[path]


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    try:
        table = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException:
        table = spark.createDataFrame([], CACHE)
    return table.where(F.col("tokenizer") == version).select("digest", "n_tokens").distinct()


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit.

    `cache` is a Parquet folder (tokenizer, digest, n_tokens) that outlives the call. A text counts
    under the SHA-256 of its UTF-8 bytes (null as empty) and the tokenizer under the digest of its
    file and library, so a changed file never meets old counts. One text of each digest that is not
    stored is encoded whole, and its count appended. Repeated rows share a count; a null doc_id
    stays null. Only missing texts move in a shuffle; a repeated entry of the cache counts once.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    digest = F.sha2(F.encode(body(), "UTF-8"), 256)
    prints = settle(docs.select("doc_id", F.octet_length(body()).cast("long").alias("n_bytes"), digest.alias("digest"), row_print().alias("row")), "digests")
    groups = prints.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("size"))
    misses = settle(groups.join(_stored(spark, cache, version), "digest", "left_anti").select("row", "size"), "misses")
    texts = docs.select(row_print().alias("row"), digest.alias("digest"), body().alias("text")).join(misses.select("row").distinct().hint("shuffle_hash"), "row", "left_semi")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for part in parts:
            yield pd.DataFrame({"tokenizer": version, "digest": part["digest"], "n_tokens": [count(t) for t in part["text"]]})

    texts.select("digest", "text").mapInPandas(run, CACHE).write.mode("append").parquet(cache)
    sizes = prints.groupBy("digest").agg(F.count("*").alias("size"))
    known = settle(sizes.join(_stored(spark, cache, version), "digest"), "known")
    out = attach_groups(prints, known, "digest", "size", prints.count())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of `documents`, from a cache of this call's own that starts empty."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "token-cache"))
