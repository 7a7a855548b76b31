"""Python stages over whole texts take bounded batches."""

from pyspark.sql import functions as F

from orbtable.llm import common


def test_a_python_stage_gets_bounded_batches_and_the_setting_is_put_back(spark):
    def sizes(parts):
        for part in parts:
            yield part.iloc[:1].assign(id=len(part))

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(2 * common.BATCH + 7, numPartitions=1)
    got = [r["id"] for r in common.settle_python(rows.mapInPandas(sizes, "id long"), "sizes").orderBy(F.desc("id")).collect()]
    assert got == [common.BATCH, common.BATCH, 7]
    assert spark.conf.get(name) == before


def test_pieces_do_not_depend_on_batches(spark, monkeypatch):
    import public_tokenizers

    from orbtable.llm import packing

    docs = spark.createDataFrame([(i, f"word{i % 7} and more " * (i % 50)) for i in range(300)], "doc_id long, text string").coalesce(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = lambda: sorted(map(tuple, packing.with_digest(packing.pack(docs, path, length=64)).collect()))
    want = rows()
    for module in (common, packing):
        monkeypatch.setattr(module, "BATCH", 37)
    got = rows()
    assert got == want
    assert sum(r[2] for r in got) == sum({r[0]: r[4] for r in got}.values())


def test_near_copies_read_texts_in_bounded_batches(spark, monkeypatch):
    from orbtable.llm import near_dedup

    seen, plain = {}, common.session.settle

    def spy(df, label="step", packed=False):
        seen.setdefault(label, []).append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return plain(df, label, packed)

    monkeypatch.setattr(common.session, "settle", spy)
    words = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(i, f"{words} x{i % 3}") for i in range(30)], "doc_id long, text string").coalesce(2)
    got = near_dedup.near_copies(docs).collect()
    assert len(got) == 30 and {r["component_id"] for r in got} == {0}
    assert seen["sketches"] == [common.BATCH] and common.BATCH in seen["edges"]
