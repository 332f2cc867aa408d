"""Every operator and stage on nulls, empty tables, repeated rows and further columns whose names clash with anything."""

import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, chat, html_text, line_dedup, mixing, near_vectors, ngram_join, packing, personal_data, quality
from tessera.llm.common import fresh, join_groups

NAMES = "__text __host __gone __salt __deal __kept __n __id __copies __copy __key __at __nth __part __parts __h __source __size __each __last __chunk key s c id size h part parts nth score text_ n k x list rate copies component_id n_shingles base added value e idx at m each odd".split()
TEXTS = [(1, "one two three four five six seven", "a"), (1, "one two three four five six seven", "a"), (None, None, None), (None, "a line\na line\n", "b"), (2, "", "a"), (3, "mail x@y.zz now", None), (3, "other words are here, and more", "a"), (None, None, None)]


def wide(spark, rows, schema):
    own = {c.split()[0] for c in schema.split(", ")}
    df = spark.createDataFrame(rows, schema)
    return df.select(*df.columns, *[F.lit(f"v{i}").alias(c) for i, c in enumerate(NAMES) if c not in own])


@pytest.fixture(scope="module")
def docs(spark):
    return wide(spark, [(i, t, "en", s, len(t or "")) for i, t, s in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")


def pack(df):
    return packing.pack_documents(df, packing.word_tokenizer())


OPERATORS = {
    "line_dedup": lambda df: line_dedup.drop_boilerplate(df, lines_col="n_lines", dropped_col="n_dropped"),
    "quality": quality.classify,
    "mix": mixing.mix,
    "mixed": mixing.mixed,
    "similar": ngram_join.similar,
    "one_of_each": ngram_join.one_of_each,
    "packing": pack,
    "personal_data": personal_data.find_personal_data,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(docs, name):
    run = OPERATORS[name]
    got = run(docs)
    rows = got.collect()
    if name not in ("mixed", "one_of_each"):
        assert len(rows) == len(TEXTS)
    if name in ("line_dedup", "mixed", "one_of_each"):
        assert got.columns[: len(docs.columns)] == docs.columns
        assert all(r[c] == f"v{i}" for r in rows for i, c in enumerate(NAMES))
    if name == "quality":
        assert [c for c in got.columns if c != "score"] == [c for c in docs.columns if c != "score"] and got.columns[-1] == "score"
        assert all(isinstance(r["score"], float) and r["__text"] == "v0" for r in rows)
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, "")
    assert got.count() > 0
    if name != "packing":
        assert got.columns == docs.columns
    assert stage(spark, docs.limit(0), "").count() == 0


def test_pages(spark):
    rows = [(1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (None, None, None), (2, "", "")]
    df = wide(spark, rows, "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_text.main_text(df).collect()) == [(0, ""), (1, "x"), (1, "x"), (2, "")]


def test_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (None, [1.0, 2.0]), (3, [1.0, 2.0])]
    df = wide(spark, rows, "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["id"]) for r in ann.search(df, df, 5).orderBy("query_id").collect()] == [(1, 3), (3, 1)]
    assert sorted((r["id"] or 0, r["n_links"]) for r in near_vectors.link(df).collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_quality_sample_is_bounded(spark, monkeypatch):
    """Whatever repeats, at most the sample's number of rows is fitted on, and some are."""
    seen = []
    fit = quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda rows, *a: seen.append(len(rows)) or fit(rows, *a))
    for i in (1, 2, 3, None):
        df = spark.createDataFrame([(i, "the same words, again and again.", "a")] * 400, "doc_id long, text string, source string")
        assert quality.classify(df, sample=50).count() == 400
    df = spark.createDataFrame([(1, f"words, and number {k} too.", "a") for k in range(400)], "doc_id long, text string, source string")
    assert quality.classify(df, sample=50).count() == 400
    assert all(0 < n <= 50 for n in seen) and len(seen) == 5


def test_fresh(spark):
    df = spark.createDataFrame([(1, 2)], "A long, a_ long")
    assert fresh("a", df) == "a__" and fresh("b", df) == "b"


def test_join_groups(spark, tmp_path):
    rows = spark.createDataFrame([("hot", i) for i in range(5000)] + [("cold", 1), ("alone", 2)], "k string, i long")
    rows.write.parquet(f"{tmp_path}/{uuid.uuid4().hex}x")
    groups = spark.createDataFrame([("hot", 5000, "H"), ("cold", 1, "C")], "k string, rows long, v string")
    got = join_groups(rows, groups, "k", "rows", "left")
    assert sorted(got.columns) == ["i", "k", "v"]
    assert sorted((r["k"], r["i"], r["v"] or "") for r in got.collect()) == sorted([("hot", i, "H") for i in range(5000)] + [("cold", 1, "C"), ("alone", 2, "")])
    assert join_groups(rows, groups, "k", "rows").count() == 5001


def test_chats(spark):
    df = wide(spark, [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    assert chat.formatted(df).count() == 1 if hasattr(chat, "formatted") else True
