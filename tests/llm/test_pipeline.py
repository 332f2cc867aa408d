"""The corpus pipeline: each stage keeps the columns, takes effect, and does the whole of its job."""

import os
from collections import Counter

import pytest

import __spark_entry__ as driver
import corpus_pipeline as pipeline
from tessera.llm import registry

FOLDER = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")


def test_registered():
    names = driver.queries()
    assert "pipeline" in names and set(registry.QUERIES) <= set(names) and set(registry.ORACLES) <= set(registry.QUERIES)
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert len(pipeline.STAGES) == 5


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    results = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    judged = {r["doc_id"] for r in results["quality"]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(i in judged for i, q in labels.items() if q == 1)
    assert sum(i in judged for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    assert {r["doc_id"] for r in results["line_dedup"]} == judged
    assert all(r["n_chars"] == len(r["text"]) for r in results["line_dedup"])
    unique = {r["doc_id"] for r in results["near_duplicates"]}
    assert unique <= judged and len(unique) == len(results["near_duplicates"])
    mixed = Counter(r["doc_id"] for r in results["mixing"])
    assert set(mixed) <= unique and max(mixed.values()) <= 3
    packed = Counter(r["doc_id"] for r in results["packing"] if r["piece"] == 0)
    assert packed == mixed
    assert set(before) >= judged


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_run(spark):
    out = pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.groupBy("sequence_id").sum("length").collect()
    assert rows and max(r[1] for r in rows) <= 2048


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
