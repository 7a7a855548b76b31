"""Filter interaction audit: what each filter removes, repeats and wastes, for every order of application."""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import HOT_GROUPS, body, documents, settle

LETTERS = "ABCDE"
BIT = {x: 1 << k for k, x in enumerate(LETTERS)}
GOOD, TOXIC = 32, 64
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of the filter that keeps single texts out of the shuffle: 256 bitmaps of 4 KB at any size of the corpus.
FILTER_BITS = 1 << 23
#: Parts that the rows of a hot text are dealt to.
SALTS = 64


def row_failures(text: Column) -> Column:
    """Bits of the filters A to D that `text` fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

    def bits(w: Column) -> Column:
        points = F.length(text)
        failing = {
            "A": F.size(w) < 200,
            "B": 100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
            "C": 100 * (points - F.length(F.translate(text, CAPITALS, ""))) > 3 * points,
            "D": text.rlike(r"[#$%&*|]"),
        }
        return reduce(Column.__add__, [F.when(test, BIT[x]).otherwise(0) for x, test in failing.items()])

    return F.transform(F.array(words), bits)[0]


def _place(value: Column) -> Column:
    return F.pmod(value, F.lit(FILTER_BITS)) + 1


def _filter_of(values: DataFrame, name: str) -> DataFrame:
    """(cell, bitmap): one bit per value of `name`; at most FILTER_BITS bits in all."""
    place = _place(F.col(name))
    return (values.select(F.bitmap_bucket_number(place).alias("cell"), F.bitmap_bit_position(place).alias("at"))
            .groupBy("cell").agg(F.bitmap_construct_agg("at").alias("bitmap")))


def _passing(rows: DataFrame, name: str, bitmaps: DataFrame) -> DataFrame:
    """Rows whose value of `name` may be among those of the filter."""
    place = _place(F.col(name))
    byte = F.conv(F.hex(F.substring("bitmap", (F.bitmap_bit_position(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftleft(1, cast(_at % 8 as int))")
    met = rows.withColumn("cell", F.bitmap_bucket_number(place)).withColumn("_at", F.bitmap_bit_position(place)).join(F.broadcast(bitmaps), "cell")
    return met.where(byte.bitwiseAND(bit) != 0).drop("cell", "_at", "bitmap")


def later_copies(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, print, part) of the documents whose text a smaller doc_id has as well, anywhere in the table.

    `rows` are (doc_id, part, print), `texts` the same with the text. Prints that occur once are kept out
    by a bitmap filter of fixed size; what passes needlessly finds no partner. A left semi join on print,
    exact text and smaller doc_id marks the rest. Its right side is the smallest doc_id of each
    text, combined before it moves. Prints with a thousandth of all rows, at most HOT_GROUPS, are dealt to
    SALTS parts, each of which gets the text once. A filter that is full lets all texts move, with the
    same result. A null doc_id is neither smaller nor larger than another.
    """
    prints = settle(rows.where("doc_id IS NOT NULL").groupBy("print").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("print", "n"), "prints")
    hot = prints.where(F.col("n") >= max(1000, rows.count() // HOT_GROUPS)).select("print", F.lit(SALTS).alias("salts"))
    maybe = _passing(texts.where("doc_id IS NOT NULL"), "print", settle(_filter_of(prints, "print"), "bitmaps"))
    maybe = maybe.join(F.broadcast(hot), "print", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    firsts = maybe.groupBy("print", "text").agg(F.min("doc_id").alias("low"), F.max("salts").alias("salts"))
    firsts = firsts.select("print", "text", "low", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).alias("f")
    dealt = maybe.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).alias("d")
    same = [F.col(f"d.{c}") == F.col(f"f.{c}") for c in ("print", "salt", "text")]
    return dealt.join(firsts, [*same, F.col("f.low") < F.col("d.doc_id")], "left_semi").select("doc_id", "print", "part")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n): documents per part and set of failed filters, with GOOD and TOXIC from `labels`."""
    keyed = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), body().alias("text")).withColumn("print", F.xxhash64("text"))
    rows = settle(keyed.select("doc_id", "part", "print", row_failures(F.col("text")).alias("bits")), "failures")
    copies = later_copies(rows, keyed).withColumn("bits", F.lit(BIT["E"])).withColumn("n", F.lit(0))
    both = rows.withColumn("n", F.lit(1)).unionByName(copies)
    judged = both.groupBy("doc_id", "print", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("bad"))
    named = judged.where("doc_id IS NOT NULL").join(known, "doc_id", "left").select(
        "part", (F.col("bits") + F.coalesce("good", F.lit(0)) + F.coalesce("bad", F.lit(0))).alias("bits"), "n")
    return named.unionByName(judged.where("doc_id IS NULL").select("part", "bits", "n")).groupBy("part", "bits").agg(F.sum("n").alias("n"))


def steps() -> list[dict]:
    """Each step of each order of the five filters: the filter's bit and those of the filters before it."""
    out = []
    for order in permutations(LETTERS):
        for k, x in enumerate(order):
            out.append({"filter_order": "".join(order), "step": k + 1, "own": BIT[x], "before": sum(BIT[y] for y in order[:k])})
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang, null as empty), filter_order and step, with the counts of the audit.

    A null or empty text has no words: it fails A, and E if a smaller doc_id has one too. Rows that repeat a
    doc_id are documents of their own; equal doc_ids are not smaller than each other. Of several labels of
    a doc_id one with quality 1 makes it good, one with toxic 1 toxic; null labels make neither. The
    documents are reduced to at most 128 combinations of bits a part before the 600 steps are counted.
    Without documents there are no parts and no rows.
    """
    plan = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    at = failures(docs, labels).select("part", "bits", "n", F.explode(plan).alias("s")).select("part", "bits", "n", "s.*")
    bits = F.col("bits").bitwiseAND(31)
    fails, earlier = bits.bitwiseAND(F.col("own")) != 0, bits.bitwiseAND(F.col("before")) != 0
    gone = fails & ~earlier
    marked = lambda mark: gone & (F.col("bits").bitwiseAND(mark) != 0)
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")
    # among all orders a document goes to each filter it fails equally often
    share = F.sum(F.when(fails, F.col("n") * 120 / F.bit_count(bits)).otherwise(0)).cast("long")
    return at.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(gone).alias("removed"), total(fails & earlier).alias("redundant"),
        total(bits == F.col("own")).alias("unique_fails"), total(marked(GOOD)).alias("good_lost"), total(marked(TOXIC)).alias("toxic_lost"),
        share.alias("shapley"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit over all `documents` and `labels`."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             doc_id > min(doc_id) OVER (PARTITION BY text) AS again FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
        len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
        regexp_matches(text, '[#$%&*|]'), coalesce(again, false)] AS fails
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, fails, count(*) AS n, len(list_filter(fails, lambda x: x)) AS k FROM f GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [p.x, q.x, r.x, s.x, u.x] AS ord FROM a p, a q, a r, a s, a u
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
g AS (SELECT array_to_string(ord, '') AS filter_order, step, ord[step] AS own, ord[1:step - 1] AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (SELECT *, fails[ascii(own) - 64] AS bad, len(list_filter(before, lambda b: fails[ascii(b) - 64])) > 0 AS gone FROM c, g)
SELECT part, filter_order, step::INT AS step,
       coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND k = 1), 0)::BIGINT AS unique_fails,
       coalesce(sum(n) FILTER (bad AND NOT gone AND good = 1), 0)::BIGINT AS good_lost,
       coalesce(sum(n) FILTER (bad AND NOT gone AND toxic = 1), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 / k) FILTER (bad), 0)::BIGINT AS shapley
FROM m GROUP BY part, filter_order, step
"""
