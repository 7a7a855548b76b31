import datetime

from pyspark.sql import functions as F

from orbtable.session import scratch_path
from orbtable.streaming import jobs


def test_a_job_goes_on_where_it_stopped(spark, sf, tmp_path):
    """Half of the events, then the other half with the same home, equal one batch over all."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("event_type").alias("kind"))
    source, home = str(tmp_path / "in"), scratch_path(spark, "home")
    stream = lambda: spark.readStream.schema(events.schema).parquet(source)
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        got = jobs.latest_wins(stream(), "user_id", ["event_id"], ["kind"], home)
    want = events.groupBy("user_id").agg(F.max_by("kind", "event_id").alias("kind"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = jobs.latest_wins(stream(), "user_id", ["event_id"], ["kind"], home)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def _moving(spark, tmp_path):
    """Streams of results (key, gen, n) and moves (key, current) over two folders, and a function that adds to them."""
    ddl = {"results": "key string, gen bigint, n bigint", "moves": "key string, current bigint"}

    def add(kind, rows):
        spark.createDataFrame(rows, ddl[kind]).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))

    def streams():
        return [spark.readStream.schema(ddl[k]).parquet(str(tmp_path / k)) for k in ("results", "moves")]

    return add, streams


def test_a_generation_that_moves_drops_what_is_on_its_way(spark, tmp_path):
    """Four runs with one home; every result is judged by the newest generation known when it is handled."""
    add, streams = _moving(spark, tmp_path)
    home = scratch_path(spark, "moving")
    steps = [
        ([("a", 1, 1), ("a", 0, 2), ("b", 5, 3), (None, 1, 4), ("a", None, 5)], [("a", 1), (None, 9)]),   # b waits
        ([("a", 1, 6), ("a", 2, 7)], [("a", 2)]),                                                         # moved within the batch
        ([("a", 1, 8), ("a", 3, 9), ("b", 4, 10)], [("b", 5), ("a", 1)]),                                 # an old move changes nothing
        ([("b", 4, 11), ("b", 6, 12)], []),                                                               # state outlives the restart
    ]
    want, newest, waiting = [], {}, []
    for results, moves in steps:
        add("results", results)
        add("moves", moves)
        got = jobs.stale_drop(*streams(), "key", "gen", home)
        for k, g in moves:
            newest[k] = max(g, newest.get(k, g))
        waiting += [r for r in results if r[0] is not None and r[1] is not None]
        want += [r for r in waiting if r[0] in newest and r[1] >= newest[r[0]]]
        waiting = [r for r in waiting if r[0] not in newest]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r[2] for r in want} == {1, 3, 7, 9, 12}


def test_state_ends_after_silence(spark, tmp_path):
    """A key that was silent for longer than allowed has no generation any more; its next one starts anew."""
    ddl = {"results": "key string, gen bigint, n bigint, at timestamp", "moves": "key string, current bigint, at timestamp"}
    home = scratch_path(spark, "silent")
    time = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)

    def run(results, moves):
        for kind, rows in (("results", results), ("moves", moves)):
            spark.createDataFrame(rows, ddl[kind]).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
        streams = [spark.readStream.schema(ddl[k]).parquet(str(tmp_path / k)) for k in ("results", "moves")]
        got = jobs.stale_drop(*streams, "key", "gen", home, clock="at", expire_ms=60_000, delay="0 seconds")
        return sorted(r["n"] for r in got.collect())

    assert run([("a", 3, 1, time(0))], [("a", 3, time(0))]) == [1]
    assert run([("a", 1, 2, time(30)), ("b", 1, 3, time(30))], [("b", 1, time(30))]) == [1, 3]
    assert run([("b", 1, 4, time(200))], []) == [1, 3, 4]  # the watermark passes a's end with this batch; b's end moved with it
    assert run([("a", 1, 5, time(210))], [("a", 1, time(210))]) == [1, 3, 4, 5]  # 3 is forgotten, else 1 were stale


def test_more_results_than_the_buffer(spark, tmp_path):
    """Results of a hot key that exceed the buffer go through the state store and none is lost."""
    add, streams = _moving(spark, tmp_path)
    rows = [("hot", n % 3, n) for n in range(60_000)]
    add("results", rows)
    add("moves", [("hot", 1)])
    got = jobs.stale_drop(*streams(), "key", "gen")
    assert sorted(r["n"] for r in got.collect()) == [n for n in range(60_000) if n % 3 >= 1]


def test_state_is_a_row_per_key(spark, tmp_path):
    """Many keys over two runs: what is known is one row a key and joined, whatever the number of keys."""
    home = scratch_path(spark, "many")
    results = spark.range(40_000).select((F.col("id") % 20_000).alias("key"), (F.col("id") % 7).alias("gen"), F.col("id").alias("n"))
    moves = spark.range(10_000).select(F.col("id").alias("key"), (F.col("id") % 5).alias("current"))
    streams = lambda: [spark.readStream.schema(d.schema).parquet(str(tmp_path / k)) for k, d in (("results", results), ("moves", moves))]
    for half in (0, 1):
        results.where(F.col("n") % 2 == half).coalesce(1).write.mode("append").parquet(str(tmp_path / "results"))
        moves.where(F.col("key") % 2 != half).coalesce(1).write.mode("append").parquet(str(tmp_path / "moves"))
        got = jobs.stale_drop(*streams(), "key", "gen", home)
    want = results.join(moves, "key").where("gen >= current").select("n")
    assert got.select("n").exceptAll(want).count() == want.exceptAll(got.select("n")).count() == 0
    assert spark.read.parquet(f"{home}/known/slot=1/keys").count() == 20_000
    assert spark.read.parquet(f"{home}/known/slot=1/waiting").count() == 20_000  # of the keys that have no generation
