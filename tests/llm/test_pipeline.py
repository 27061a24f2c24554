"""The pipeline on a small folder of tables: what each stage must turn away, and what stays."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import docs, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    base = tmp_path_factory.mktemp("tables")
    clean = [(k, prose(rng, 150), "en", f"s{k % 3}") for k in range(200)]
    item = prose(rng, 30)
    short = [(300, "too short", "en", "s0"), (301, None, "en", "s0"), (302, "", None, None)]
    junk = [(310 + k, " ### ".join(prose(rng, 90).split()), "en", "s1") for k in range(4)]
    copied = [(320, clean[5][1], "en", "s2"), (321, clean[6][1] + " one more", "en", "s0")]
    leaked = [(330, prose(rng, 80) + " " + item + " " + prose(rng, 80), "en", "s0")]
    numbers = [(340, " ".join(str(rng.randrange(10**6)) for _ in range(150)), "en", "s0")]
    rows = clean + short + junk + copied + leaked + numbers
    docs(spark, rows).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), {r[0] for r in clean}


def test_each_stage(spark, folder):
    base, clean = folder
    current = spark.read.parquet(f"{base}/documents.parquet")
    columns, left = current.columns, {r["doc_id"] for r in current.select("doc_id").collect()}
    gone = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, current, base)
        assert out.columns == columns
        out.write.parquet(f"{base}/{k}")
        current = spark.read.parquet(f"{base}/{k}")
        now = {r["doc_id"] for r in current.select("doc_id").collect()}
        gone[name], left = left - now, now
    assert gone == {"quality": {300, 301, 302, 310, 311, 312, 313}, "language": {340}, "near_duplicates": {320, 321}, "decontamination": {330}}
    packed = corpus_pipeline.STAGES[-1][1](spark, current, base)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == clean


def test_run_equals_its_stages(spark, folder):
    base, clean = folder
    got = corpus_pipeline.run(spark, base)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == clean


def test_empty_tables(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
