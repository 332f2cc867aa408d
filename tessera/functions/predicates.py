"""The operators of filters, for scalar and for array columns, with the null semantics of SQL as the language defines them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (column, operand as a literal maker, operand) -> predicate
Operator = Callable[[Column, Callable[[object], Column], object], Column]


def _eq(c: Column, lit, v) -> Column:
    return c.isNull() if v is None else c == lit(v)


def _ne(c: Column, lit, v) -> Column:
    return c.isNotNull() if v is None else ~c.eqNullSafe(lit(v))


def _in(c: Column, lit, v) -> Column:
    return c.isin([lit(x) for x in v]) if v else F.lit(False)


def _nin(c: Column, lit, v) -> Column:
    return ~c.isin([lit(x) for x in v]) if v else F.lit(True)


def _exists(c: Column, lit, v) -> Column:
    return c.isNotNull() if v else c.isNull()


def _prefix(c: Column, lit, v) -> Column:
    # percent and underscore in the operand stay wildcards; a backslash is an ordinary character
    return c.cast("string").like(str(v).replace("\\", "\\\\") + "%")


SCALAR: dict[str, Operator] = {
    "$eq": _eq,
    "$ne": _ne,
    "$lt": lambda c, lit, v: c < lit(v),
    "$lte": lambda c, lit, v: c <= lit(v),
    "$gt": lambda c, lit, v: c > lit(v),
    "$gte": lambda c, lit, v: c >= lit(v),
    "$prefix": _prefix,
    "$in": _in,
    "$nin": _nin,
    "$exists": _exists,
}


def _array(lit, v) -> Column:
    return F.array(*[lit(x) for x in v])


def _overlap(c: Column, lit, v) -> Column:
    # a null element never counts as a match, nor does it make the answer unknown
    values = [x for x in v if x is not None]
    return F.arrays_overlap(F.array_compact(c), _array(lit, values)) if values else F.when(c.isNotNull(), F.lit(False))


def _all(c: Column, lit, v) -> Column:
    if any(x is None for x in v):
        return F.when(c.isNotNull(), F.lit(False))
    return F.size(F.array_except(_array(lit, v), c)) == 0 if v else F.when(c.isNotNull(), F.lit(True))


def _contains(c: Column, lit, v) -> Column:
    if v is None:
        return c.isNull()
    return c == _array(lit, v) if isinstance(v, list) else F.array_contains(c, lit(v))


def _differs(c: Column, lit, v) -> Column:
    if v is None:
        return c.isNotNull()
    return c != _array(lit, v) if isinstance(v, list) else ~F.array_contains(c, lit(v))


ARRAY: dict[str, Operator] = {
    "$eq": _contains,
    "$ne": _differs,
    "$in": _overlap,
    "$nin": lambda c, lit, v: ~_overlap(c, lit, v),
    "$exists": _exists,
    "$all": _all,
    # a null array has no elements, like an empty one
    "$size": lambda c, lit, v: F.coalesce(F.size(c), F.lit(0)) == 0 if v == 0 else F.size(c) == v,
}

#: Operators whose operand must be a list.
LISTS = frozenset({"$in", "$nin", "$all"})
