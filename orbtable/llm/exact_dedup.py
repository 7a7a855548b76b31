"""Exact dedup: two Bloom passes find texts that may repeat; only those rows are grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import attach_groups, body, documents, power_of_two, settle


def _filter_words(rows: DataFrame, print_col: str, n: int) -> DataFrame:
    """Words of a Bloom filter over `print_col` that some bit was set in twice.

    The filter is a table of 64-bit words, about one per row, so it grows with the rows and stays
    dealt over the cluster. A word with as many rows as bits has seen no print twice.
    """
    word = F.shiftrightunsigned(print_col, 6).bitwiseAND(power_of_two(n) - 1)
    bit = F.expr(f"shiftleft(1L, cast({print_col} & 63 as int))")
    return (rows.select(word.alias("word"), bit.alias("bit")).groupBy("word")
            .agg(F.count("*").alias("n"), F.bit_or("bit").alias("bits"))
            .where("n > bit_count(bits)").select("word"))


def _maybe_repeated(rows: DataFrame, print_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """`rows` as (may repeat, surely single) by one Bloom pass."""
    words = settle(_filter_words(rows, print_col, n), "bloom")
    keyed = rows.withColumn("word", F.shiftrightunsigned(print_col, 6).bitwiseAND(power_of_two(n) - 1))
    return keyed.join(words, "word", "left_semi").drop("word"), keyed.join(words, "word", "left_anti").drop("word")


def mark_copies(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical (null as empty); of equal texts the largest doc_id stays. The text
    is read once, and only its digest and two prints move. A pass builds a Bloom filter over the
    prints and keeps rows whose word collides; the second pass repeats that over the survivors with
    another hash. Rows outside are single and pass through; the rest are grouped by digest with
    map-side combination. Rows that repeat a doc_id with the same text are one document and share
    its verdict. A null doc_id never wins against a number; if all are null, all are kept. An empty
    table gives an empty result.
    """
    rows = settle(docs.select(
        "doc_id", F.sha2(F.encode(body(), "UTF-8"), 256).alias("text_sha256"), F.xxhash64(body()).alias("p")), "digests")
    n = rows.count()
    once, single = _maybe_repeated(rows, "p", n)
    once = settle(once.withColumn("q", F.xxhash64("p", F.lit(1))), "once")
    maybe, single_too = _maybe_repeated(once, "q", once.count())
    maybe = settle(maybe.select("doc_id", "text_sha256"), "maybe")
    groups = settle(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    copies = attach_groups(maybe, groups, "text_sha256", "group_size", n)
    alone = single.select("doc_id", "text_sha256").union(single_too.select("doc_id", "text_sha256"))
    alone = alone.select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return alone.unionByName(copies).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their own columns; a repeated document once."""
    lost = mark_copies(docs).where("not kept").select(F.col("doc_id").alias("_lost_id"), F.col("text_sha256").alias("_lost_sha")).distinct()
    sha = F.sha2(F.encode(body(), "UTF-8"), 256)
    return docs.join(lost.hint("shuffle_hash"), docs.doc_id.eqNullSafe(F.col("_lost_id")) & (sha == F.col("_lost_sha")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of whole texts in `documents`."""
    return mark_copies(documents(spark, sf_dir))


SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
