"""Where models' rows come from, and where results may go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(name: str):
    """A source that reads <folder>/<name>.parquet."""
    return lambda spark, folder: spark.read.parquet(f"{folder}/{name}.parquet")


def table(name: str):
    """A source that reads a catalog table."""
    return lambda spark, folder: spark.table(name)


#: Keys of one request up to which they are broadcast; more are joined as Spark sees fit.
KEYS_BROADCAST = 10_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, known to have at most so many rows, with a broadcast hint if they are few."""
    return F.broadcast(df) if rows <= KEYS_BROADCAST else df


def by_keys(df: DataFrame, keys: list[tuple], columns: tuple[str, ...]) -> DataFrame:
    """The rows with one of the given primary keys, which are joined as a table."""
    spark: SparkSession = df.sparkSession
    wanted = spark.createDataFrame(list(dict.fromkeys(map(tuple, keys))), df.select(*columns).schema) if keys else df.select(*columns).limit(0)
    return df.join(few(wanted, len(keys)), list(columns), "left_semi")


def json_lines(df: DataFrame) -> DataFrame:
    """One column of JSON text, nested relations included."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
