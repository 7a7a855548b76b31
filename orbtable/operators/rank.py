"""Order statistics and consecutive numbering without gathering a group in one task.

A mesh, cloud or field may hold a large share of all rows, so nothing here runs a window
over a whole group: ranks come from counts per bucket plus a window inside small buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbtable.session import settle

BLOCK = 1 << 16


def number_by_ordinal(df: DataFrame, keys: list[str], ordinal: str, out: str, block: int = BLOCK) -> DataFrame:
    """0-based consecutive numbers within `keys` in the order of a unique integer column.

    Blocks of the ordinal bound every window: a block holds at most `block` rows because
    ordinals are unique, and the offsets are a window over the much smaller block counts.
    """
    df = df.withColumn("_blk", F.floor(F.col(ordinal) / block).cast("bigint"))
    counts = df.groupBy(*keys, "_blk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_blk").orderBy(ordinal)
    return (
        df.join(offsets, [*keys, "_blk"])
        .withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_blk", "_off")
    )


def number_by_value(df: DataFrame, keys: list[str], value: str, tie: str, out: str, buckets: int = 256) -> DataFrame:
    """0-based consecutive numbers within `keys` ordered by (value, tie); `tie` is a unique integer.

    Bucket edges are approximate quantiles, which only balance the work: any edges give the
    same numbers. Rows equal to an edge form buckets of their own, split further by blocks of
    the tie column, so a value shared by a third of the rows does not make a hot bucket.
    """
    probs = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    edges = df.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, probs, F.lit(20 * buckets))).alias("_edges")
    )
    df = df.join(edges, keys)
    # binary search for the number of edges below the value; edges are ascending
    top = max(1, (buckets - 1).bit_length())
    lo_hi = F.aggregate(
        F.sequence(F.lit(1), F.lit(top + 1)),
        F.struct(F.lit(0).alias("lo"), F.size("_edges").alias("hi")),
        lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(
            F.when(
                F.get("_edges", F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")) < F.col(value),
                F.struct((F.floor((acc["lo"] + acc["hi"]) / 2) + 1).cast("int").alias("lo"), acc["hi"].alias("hi")),
            ).otherwise(
                F.struct(acc["lo"].alias("lo"), F.floor((acc["lo"] + acc["hi"]) / 2).cast("int").alias("hi"))
            )
        ),
    )
    df = df.withColumn("_k", lo_hi["lo"])
    on_edge = F.coalesce(F.get("_edges", F.col("_k")) == F.col(value), F.lit(False))
    df = df.withColumn("_e", on_edge).drop("_edges")
    df = df.withColumn("_blk", F.when(F.col("_e"), F.floor(F.col(tie) / BLOCK)).otherwise(F.lit(0)).cast("bigint"))
    bucket = ["_k", "_e", "_blk"]
    counts = df.groupBy(*keys, *bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, *bucket).orderBy(value, tie)
    return (
        df.join(offsets, [*keys, *bucket])
        .withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_k", "_e", "_blk", "_off")
    )


def index_of(rule: str, q: float, n: Column) -> Column:
    """0-based index of a quantile: 'floor' and 'round' (half up) of q * (n - 1), or 'half' = n div 2."""
    if rule == "half":
        return F.floor(n / 2).cast("bigint")
    shift = {"floor": 0.0, "round": 0.5}[rule]
    return F.floor(F.lit(float(q)) * (n - 1) + shift).cast("bigint")


#: Counters of a selection pass: 2^DIGIT for each key and pick.
DIGIT = 12


def order_bits(value: Column) -> Column:
    """A long that orders like the double `value`; both zeros are one."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict, accuracy: int = 10000) -> DataFrame:
    """Exact order statistics by index rule: one row per key with one column per pick.

    `picks` maps an output column to (rule, q) as in index_of.
    A mergeable quantile sketch brackets each index. Radix selection then narrows the bracket: a pass counts the
    values in it by their next DIGIT order-preserving bits, moves to the digit that holds the index and to the least and
    greatest value found there, until these are one. Six passes do for any doubles, one or two as a rule; a pass
    groups 2^DIGIT counters and never the values. A bracket that misses its index (it cannot, within the
    sketch's guarantee) fails the job instead of returning a wrong value.
    """
    vals = settle(df.select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_k", order_bits(F.col("_v"))), "values")
    names = list(picks)
    eps = 4.0 / accuracy
    # the sketch is asked on both sides of every index, four error bounds away
    span = {nm: (max(0.0, q - eps), min(1.0, q + eps)) for nm, (_, q) in picks.items()}
    grid = sorted({p for pair in span.values() for p in pair})
    sketch = vals.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(p) for p in grid]), F.lit(accuracy)).alias("_s"),
        F.min("_k").alias("_min"), F.max("_k").alias("_max"))
    # a group of a few thousand rows is its own bracket
    tiny = F.col("_n") * eps < 2
    state = sketch.select(*keys, "_n", F.inline(F.array(*[
        F.struct(F.lit(nm).alias("pick"), index_of(*picks[nm], F.col("_n")).alias("_idx"),
                 F.when(tiny, F.col("_min")).otherwise(order_bits(F.col("_s")[grid.index(span[nm][0])])).alias("_lo"),
                 F.when(tiny, F.col("_max")).otherwise(order_bits(F.col("_s")[grid.index(span[nm][1])])).alias("_hi")) for nm in names])))
    found, first = None, True
    while True:
        # halves keep the width of a bracket across zero within a long
        wide = F.length(F.bin(F.shiftright("_hi", 1) - F.shiftright("_lo", 1))) + 1
        state = state.withColumn("_shift", F.greatest(wide - DIGIT, F.lit(0)))
        per_key = state.groupBy(*keys).agg(F.collect_list(F.struct("pick", "_n", "_idx", "_lo", "_hi", "_shift")).alias("_p"))
        met = vals.join(per_key, keys).select(*keys, "_v", "_k", F.inline("_p")).where("_k <= _hi")
        if not first:  # the index now counts from _lo
            met = met.where("_k >= _lo")
        below = F.col("_k") < F.col("_lo")
        digit = F.when(~below, F.expr("shiftright(_k, _shift) - shiftright(_lo, _shift)")).otherwise(-1)
        counts = met.groupBy(*keys, "pick", digit.alias("_digit")).agg(
            F.count("*").alias("_c"), F.max("_n").alias("_n"), F.max("_idx").alias("_idx"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"), F.min("_v").alias("_value"))
        run = Window.partitionBy(*keys, "pick").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        ahead = F.col("_cum") - F.col("_c")
        hit = counts.withColumn("_cum", F.sum("_c").over(run)).where((F.col("_cum") > F.col("_idx")) & (ahead <= F.col("_idx")) & (F.col("_digit") >= 0))
        hit = settle(hit.select(*keys, "pick", "_n", (F.col("_idx") - ahead).alias("_idx"), "_lo", "_hi", "_value"), "selection")
        settled = hit.where("_lo = _hi").select(*keys, "pick", "_n", "_value")
        found = settled if found is None else found.unionByName(settled)
        state = hit.where("_lo < _hi").drop("_value")
        if not state.limit(1).count():
            break
        vals, first = vals.join(state.select(*keys).distinct(), keys, "left_semi"), False
    # a key without its picks would be a missed bracket; keys without any value have none
    out = sketch.where("_min IS NOT NULL").select(*keys, F.col("_n").alias("n")).join(
        found.groupBy(*keys).agg(*[F.max(F.when(F.col("pick") == nm, F.col("_value"))).alias(nm) for nm in names]), keys, "left")
    missed = F.raise_error(F.lit("quantile bracket missed its index")).cast("double")
    return out.select(*keys, "n", *[F.coalesce(nm, missed).alias(nm) for nm in names])


def lowest_share(df: DataFrame, keys: list[str], value: str, tie: str, count: Column, highest: bool = False) -> DataFrame:
    """Rows among the `count(n)` smallest (or largest) by (value, tie) in their group.

    `count` is an expression over the column `n`, the size of the group.
    """
    v = -F.col(value) if highest else F.col(value)
    df = df.withColumn("_w", v)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, count.cast("bigint").alias("_k"))
    return (
        number_by_value(df, keys, "_w", tie, "_r").join(sizes, keys)
        .where(F.col("_r") < F.col("_k")).drop("_w", "_k")
        .withColumnRenamed("_r", "rank")
    )
