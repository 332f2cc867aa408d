"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents. Null, empty, repeated and tied rows are treated as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint_folder, fresh, remove
from tessera.llm.line_dedup import drop_boilerplate
from tessera.llm.mixing import mixed
from tessera.llm.ngram_join import one_of_each
from tessera.llm.packing import pack_documents, word_tokenizer
from tessera.llm.quality import THRESHOLD, classify


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    score = fresh("__score", docs)
    return classify(docs, score_col=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays, and n_chars follows its text."""
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays. As the contract leaves the measure open: five words, 80 %."""
    return one_of_each(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand there as often as the mix of sources copies them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its sequence and its place there; doc_id repeats where the mix repeats a document."""
    return pack_documents(docs, word_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", packing)]

#: The classifier, the mix's hashes and the genetic packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and removed when it was read."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            remove(spark, done)
        done = f"{folder}/{name}"
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)  # packing has read the documents and keeps its pieces when it returns
    return out
