"""The n-gram join: words that occur once are no postings, and how they are asked about changes no result."""

from collections import Counter

from tessera.llm import ngram_join

from .test_texts import brute, corpus, frame


def stages(spark):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    return spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())


def shuffled(spark, run):
    """Records written to shuffles while run() runs."""
    spark.range(8).repartition(2).collect()
    at = stages(spark)
    last = max(at.apply(i).stageId() for i in range(at.size()))
    run()
    at = stages(spark)
    return sum(at.apply(i).shuffleWriteRecords() for i in range(at.size()) if at.apply(i).stageId() > last)


def test_single_words_are_not_shuffled(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(200)]
    near = [f"{texts[i]} end" for i in range(5)]
    rows = [(i, t, "s") for i, t in enumerate(texts + near)]
    got = []
    # 396 shingles of five words: 79 + 8 in the prefix of each text
    records = shuffled(spark, lambda: got.extend(ngram_join.one_of_each(frame(spark, rows), words=5, percent=80).select("doc_id").collect()))
    assert sorted(r["doc_id"] for r in got) == list(range(200))
    assert records < 200 * 87


def test_many_slabs_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLAB", 300)
    monkeypatch.setattr(ngram_join, "GROUP", 200)
    rows = corpus(seed=9)
    got = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar(frame(spark, rows), words=5, percent=80).collect())
    assert got == brute(rows, 5, 80)
