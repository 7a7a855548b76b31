"""Structured Streaming counterparts of interactive requests on spectra.

Every job runs with trigger(availableNow=True) and writes Parquet through foreachBatch keyed by batch
id. `home` names the folder of a job's output and state: called again with it, the job goes on with
what has arrived since, and a batch that was cut off overwrites itself. Without it a job starts anew
in a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.functions.spectral import angle_cos, angle_sin
from orbtable.operators import spectral as sp
from orbtable.session import scratch_path, settle
from orbtable.streaming.generations import Generations, tagged


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(stream: DataFrame, per_batch, mode: str = "append", home: str | None = None) -> DataFrame:
    """Run a stream over what is available; per_batch(df, id) is written under its batch id, and all batches read back."""
    spark = stream.sparkSession
    home = home or scratch_path(spark, "stream")
    out = f"{home}/out"

    def write(df: DataFrame, batch: int) -> None:
        per_batch(df, batch).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


def latest_wins(requests: DataFrame, key: str, order: list[str], payload: list[str], home: str | None = None) -> DataFrame:
    """Only the newest request per key survives: a streaming max_by, then the last batch of each key.

    The state is one row per key and is kept: a key's standing request has no end.
    """
    newest = requests.groupBy(key).agg(F.max(F.struct(*order, *payload)).alias("m"))
    done = drain(newest, lambda df, _: df.select(key, "m.*"), "update", home)
    return done.groupBy(key).agg(F.max(F.struct("batch", *order, *payload)).alias("m")).select(key, *[f"m.{c}" for c in payload])


def stale_drop(
    results: DataFrame, moves: DataFrame, key: str, generation: str, home: str | None = None,
    clock: str | None = None, expire_ms: int = 86_400_000, delay: str = "1 hour",
) -> DataFrame:
    """Results whose generation is at least the key's current one when they are handled. Only the generation counts, not the time.

    Both are streams: `moves` has (key, current), the numbers of started generations, in any order; the largest counts. A
    generation that moves during the run, or between two runs with the same `home`, drops what is still on its way. A
    result of a key without a generation waits for the first. Results already written stay.

    Without `clock` state has no end. With it, a timestamp column of both streams, a key's state, waiting results included,
    ends once the watermark (the newest time less `delay`) is `expire_ms` past the key's last row, and rows behind the
    watermark are dropped.
    """
    home = home or scratch_path(results.sparkSession, "stream")
    known = Generations(results.sparkSession, home, generation, clock, expire_ms, delay)
    return drain(tagged(results, moves, key, generation, clock), known.judge, home=home).drop("batch")


def filter_apply(specs: DataFrame, power: DataFrame, lmax: int, home: str | None = None) -> DataFrame:
    """Re-weight fixed spectra for every incoming filter spec: the stream meets a table that is written once."""
    power = settle(power, "power")
    return drain(specs, lambda df, _: sp.filter_report(power, sp.gains_for(df, lmax), lmax), home=home).drop("batch")


def stream_ring_sums(cells: DataFrame, nphi: int, mmax: int, delay: str = "1 hour", home: str | None = None) -> DataFrame:
    """Daily Fourier sums per ring of a stream of (field_id, i, j, value, ts): closed days only.

    The sums are linear in the events, so they are one windowed aggregation whose state is a
    row per (day, field, ring).
    """
    sums = []
    for m in range(mmax + 1):
        sums.append(F.sum(F.col("value") * angle_cos(F.lit(m), F.col("j"), nphi)).alias(f"c{m}"))
        sums.append(F.sum(F.col("value") * angle_sin(F.lit(m), F.col("j"), nphi)).alias(f"s{m}"))
    agg = cells.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("win"), "field_id", "i").agg(*sums)
    day = F.date_format("win.start", "yyyy-MM-dd").alias("window_day")
    return drain(agg, lambda df, _: df.select(day, "field_id", "i", *[c for c in df.columns if c not in ("win", "field_id", "i")]), home=home).drop("batch")


def stream_spectrum(cells: DataFrame, nlat: int, nphi: int, lmax: int, home: str | None = None) -> DataFrame:
    """(window_day, event_type, l, p): power per degree of every closed day."""
    sums = stream_ring_sums(cells, nphi, lmax, home=home)
    h = sp.TAU / nphi
    modes = F.array(*[F.struct(F.lit(m).alias("m"), (h * F.col(f"c{m}")).alias("re"), (-h * F.col(f"s{m}")).alias("im")) for m in range(lmax + 1)])
    g = sums.select(F.concat_ws("\u0001", "window_day", "field_id").alias("field_id"), F.lit("v").alias("comp"), "i", F.inline(modes))
    wy = F.col("w") * F.col("y")
    q = sp.basis_join(g, nlat, lmax).groupBy("field_id", "comp", "l", "m").agg(
        F.sum(wy * F.col("re")).alias("re"), F.sum(wy * F.when(F.col("m") == 0, 0.0).otherwise(F.col("im"))).alias("im"))
    part = F.split("field_id", "\u0001")
    return sp.power_spectrum(q).select(part[0].alias("window_day"), part[1].alias("event_type"), "l", "p")
