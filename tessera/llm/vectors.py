"""What the vector operators share: which vectors take part, exact copies as one, vectors as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = float("inf")


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero in length."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(BAD)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v is array<double>, ids without null."""
    v = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, summed in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
