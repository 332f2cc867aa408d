"""skip, limit and the max_items setting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidQueryError


def parse(skip: object, limit: object, most: int | None = None) -> tuple[int, int | None]:
    for name, v in (("skip", skip), ("limit", limit)):
        if v is not None and (isinstance(v, bool) or not isinstance(v, int)):
            raise InvalidQueryError(f"{name} must be a whole number")
    skip, limit = (v if v is not None and v > 0 else None for v in (skip, limit))
    if most:
        limit = min(limit or most, most)
    return skip or 0, limit


def page(df: DataFrame, skip: int, limit: int | None) -> DataFrame:
    df = df.offset(skip) if skip else df
    return df.limit(limit) if limit else df


def page_per_parent(df: DataFrame, keys: list[str], order: list[Column], skip: int, limit: int | None) -> DataFrame:
    """Each parent's rows numbered in __rn, of which skip are left out and at most limit stay."""
    df = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if skip:
        df = df.where(F.col("__rn") > skip)
    return df.where(F.col("__rn") <= skip + limit) if limit else df
