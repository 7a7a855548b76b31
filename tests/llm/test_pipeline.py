"""The pipeline's stages on what their predecessors kept."""

from collections import defaultdict

import public_tokenizers

import corpus_pipeline
from orbtable.llm import packing, private_data, quality_rules
from tests.llm.test_copies import brute_components
from tests.llm.test_texts import brute_rules, check_pieces

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    text = dict(map(tuple, docs.select("doc_id", "text").collect()))
    verdicts = quality_rules.judge(docs, quality_rules.trusted_ids(spark, SF)).collect()
    alive = {r["doc_id"] for r in verdicts if not brute_rules(text[r["doc_id"]])[-1] and r["score"] >= quality_rules.LEAST}
    stages = dict(corpus_pipeline.STAGES)
    steps, columns = {}, docs.columns
    for name in ("quality_rules", "exact_dedup", "near_dedup", "private_data"):
        docs = spark.createDataFrame(stages[name](spark, docs, SF).collect(), docs.schema).repartition(4)
        assert docs.columns == columns
        steps[name] = dict(map(tuple, docs.select("doc_id", "text").collect()))
    assert set(steps["quality_rules"]) == alive
    groups = defaultdict(list)
    for i in alive:
        groups[text[i]].append(i)
    assert set(steps["exact_dedup"]) == {max(g) for g in groups.values()}
    near = brute_components([(i, text[i]) for i in steps["exact_dedup"]], 5)
    assert set(steps["near_dedup"]) == {i for i, _, _, kept in near if kept}
    assert set(steps["private_data"]) == set(steps["near_dedup"])
    changed = {i for i, t in steps["private_data"].items() if t != text[i]}
    plain = spark.createDataFrame([(i, text[i]) for i in steps["near_dedup"]], "doc_id long, text string")
    assert changed == {r["doc_id"] for r in plain.select("doc_id", private_data.entities(plain.text).alias("e")).where("size(e) > 0").collect()}
    check_pieces(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect(), list(steps["private_data"].items()))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count()
