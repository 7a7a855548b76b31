"""Results judged by the generation of their key, which may move while the stream runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.session import write_plain


def tagged(results: DataFrame, moves: DataFrame, key: str, generation: str, clock: str | None = None) -> DataFrame:
    """One stream (key, at, moved, row) of both: microseconds if there is a clock, and either the number of a generation or a result.

    Rows with a null key or generation are dropped.
    """
    at = F.lit(None).cast("bigint") if clock is None else F.unix_micros(F.col(clock).cast("timestamp"))
    mine = results.where(F.col(key).isNotNull() & F.col(generation).isNotNull()).select(
        F.col(key).alias("key"), at.alias("at"), F.lit(None).cast("bigint").alias("moved"), F.struct(*results.columns).alias("row"))
    moved = moves.where(F.col(key).isNotNull() & F.col("current").isNotNull()).select(
        F.col(key).alias("key"), at.alias("at"), F.col("current").cast("bigint").alias("moved"), F.lit(None).cast(results.schema).alias("row"))
    return mine.unionByName(moved)


class Generations:
    """What a job knows after each batch, as three tables under `home`.

    keys(key, current, last): newest generation, if any, and time of the last row; waiting(key, row): results of keys
    without a generation; clock(watermark). A batch reads what its predecessor wrote and writes them anew beside it, so
    one that was cut off starts again from the same tables. All of it is joins by key: no key is a group of its own.
    """

    def __init__(self, spark: SparkSession, home: str, generation: str, clock: str | None, expire_ms: int, delay: str):
        self.spark, self.home, self.generation, self.clock, self.expire_ms, self.delay = spark, home, generation, clock, expire_ms, delay

    def _table(self, name: str, batch: int) -> str:
        return f"{self.home}/known/slot={batch % 2}/{name}"

    def _before(self, name: str, batch: int, schema) -> DataFrame:
        """A table as the batch before left it; empty before the first."""
        if batch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._table(name, batch - 1))

    def _after(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        write_plain(df, self._table(name, batch), "overwrite")
        return self.spark.read.schema(df.schema).parquet(self._table(name, batch))

    def judge(self, df: DataFrame, batch: int) -> DataFrame:
        """The results of a batch, and of those before that waited, that are not stale.

        All of a batch's moves count before its results, so a result on its way when the generation moves is dropped.
        """
        # the session of a running stream plans without adaptive joins, which split the rows of a hot key
        arrived, end = self._after("arrived", batch, df), F.lit(None).cast("bigint")
        if self.clock is not None:
            was = self._before("clock", batch, "watermark bigint")
            past = was.agg(F.max("watermark")).first()[0]
            arrived = arrived.where(F.col("at").isNull() | (F.col("at") > past)) if past is not None else arrived
            top = arrived.select(F.unix_micros(F.timestamp_micros(F.max("at")) - F.expr(f"INTERVAL {self.delay}")).alias("watermark"))
            now = self._after("clock", batch, was.unionByName(top).agg(F.max("watermark").alias("watermark")))
            end = F.lit(now.first()[0]).cast("bigint") - self.expire_ms * 1000
        news = arrived.select("key", F.col("moved").alias("current"), F.col("at").alias("last"))
        keys = self._before("keys", batch, news.schema).unionByName(news).groupBy("key").agg(F.max("current").alias("current"), F.max("last").alias("last"))
        known = self._after("judged_by", batch, keys)  # with those that end with this batch
        kept = self._after("keys", batch, known.where(F.coalesce(F.col("last") > end, F.lit(True))))
        rows = arrived.where("row IS NOT NULL").select("key", "row")
        rows = self._before("waiting", batch, rows.schema).unionByName(rows)
        self._after("waiting", batch, rows.join(kept.where("current IS NULL"), "key", "left_semi"))
        return rows.join(known.where("current IS NOT NULL"), "key").where(F.col("row")[self.generation] >= F.col("current")).select("row.*")
