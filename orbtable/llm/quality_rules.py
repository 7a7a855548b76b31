"""Quality rules: base counts of a text and a log-likelihood ratio of its hashed n-grams."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import body, documents, free_name, settle

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Hash buckets of the n-grams: half for words, half for pairs of words.
BUCKETS = 1 << 15
#: Weight of the raw corpus in the smoothing of the target's multinomial, in grams: five a bucket.
PRIOR = 5.0 * BUCKETS
#: Least mean log-likelihood ratio (natural log, per n-gram) of a kept text.
LEAST = -0.07


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of `value`, which is evaluated once for a row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _covered(hashes: Column) -> Column:
    """Words that lie in windows whose hash occurs twice or more."""
    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda e: e["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        let(ordered, positions), start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"])


def repeated_words(words: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
    return F.when(F.size(words) < WINDOW, 0).otherwise(found)


def _word_bucket(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(BUCKETS // 2 - 1).cast("int")


def _pair_bucket(first: Column, second: Column) -> Column:
    return (F.xxhash64(first, second).bitwiseAND(BUCKETS // 2 - 1) + BUCKETS // 2).cast("int")


def _pairs(words: Column, use: Callable[[Column, Column], Column]) -> Column:
    return F.when(F.size(words) < 2, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(2), F.size(words)), lambda i: use(F.element_at(words, i - 1), F.element_at(words, i))))


def _counts(texts: DataFrame) -> DataFrame:
    """Rows per bucket over all n-grams of all texts; combined before the shuffle, at most BUCKETS rows."""
    grams = let(words_of(F.col("text")), lambda w: F.concat(F.transform(w, _word_bucket), _pairs(w, _pair_bucket)))
    return texts.select(F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> Column:
    """A literal array: per bucket the log of target over raw probability, to four places.

    The ids of the target grow with the corpus, so they are dealt out and never broadcast. Counts run over all texts of `docs` and over all of those whose doc_id is in `trusted`. The
    target is smoothed with PRIOR grams of the raw corpus; without trusted texts all weights are 0.
    The array has BUCKETS numbers at any size of the corpus.
    """
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    texts = docs.select("doc_id", body().alias("text"))
    raw = _counts(texts).select("bucket", F.col("n").alias("r"), F.lit(0).cast("long").alias("t"))
    good = _counts(texts.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")).select("bucket", F.lit(0).cast("long"), F.col("n"))
    every = raw.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    cells = settle(raw.union(good).union(every).groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t")), "grams")
    total, target = cells.agg(F.sum("r") + F.lit(float(BUCKETS)), F.sum("t") + F.lit(PRIOR)).first()
    # a gram is weighed without itself, else rare grams would speak against any text outside the target
    p = (F.greatest(F.col("r") - 1, F.lit(0)) + 1.0) / total
    weight = F.round(F.log((F.col("t") + p * PRIOR) / target / p), 4).alias("w")
    rows = sorted((r["bucket"], r["w"]) for r in cells.select("bucket", weight).collect())  # BUCKETS rows
    return F.from_json(F.lit(json.dumps([w for _, w in rows])), "array<double>")


def measures(weights: Column) -> Column:
    """The counts, base_failed and score of `text` as one struct, computed in the row."""
    text = body()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

    def measured(w: Column) -> Column:
        words = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.get(weights, _word_bucket(x)))
        pairs = F.aggregate(_pairs(w, _pair_bucket), F.lit(0.0), lambda a, b: a + F.get(weights, b))
        grams = F.greatest(F.size(w) * 2 - 1, F.lit(1))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"), ((words + pairs) / grams).alias("score"))

    return let(words_of(text), measured)


def with_verdict(docs: DataFrame, trusted: DataFrame, least: float, mark: str) -> DataFrame:
    """`docs` with a struct `mark` of the counts, base_failed, kept and score."""
    m = lambda name: F.col(mark)[name]
    failed = (m("n_words") < 20) | (100 * m("n_repeat_words") > 30 * m("n_words"))
    counts = [m(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return docs.withColumn(mark, measures(bucket_weights(docs, trusted))).withColumn(mark, F.struct(
        *counts, failed.alias("base_failed"), (~failed & (m("score") >= least)).alias("kept"), m("score").alias("score")))


def judge(docs: DataFrame, trusted: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of `docs`: doc_id, the base counts, base_failed, kept and score.

    score is the sum of the weights of all words and pairs of words over their number, 0 without
    words; every document is judged by the same threshold, with no chance involved. A null or empty
    text has no words and fails the base rules, as do fewer than 20 words or more than 30 % of
    words in repeated windows of eight. Repeated rows repeat; a null doc_id stays null.
    """
    return with_verdict(docs.select("doc_id", "text"), trusted, least, "m").select("doc_id", "m.*")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def keep_good(docs: DataFrame, trusted: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of `docs` that pass, with their own columns; each row is judged where it is read."""
    mark = free_name(docs, "_verdict")
    return with_verdict(docs, trusted, least, mark).where(F.col(mark)["kept"]).drop(mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over all `documents`; the target is what `labels` calls good."""
    return judge(documents(spark, sf_dir), trusted_ids(spark, sf_dir))
