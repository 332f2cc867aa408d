"""aggregate and group."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DisabledError, InvalidQueryError
from ..model import Model, Scope
from . import filter as filters

AGGREGATED = frozenset({"column", "json", "struct", "hybrid"})
FUNCTIONS = {"$min": F.min, "$max": F.max, "$avg": F.avg, "$sum": F.sum}


@dataclass(frozen=True)
class Aggregate:
    """label: a column (operator None), an operator on a column, a count times a number, or a count of matches."""

    label: str
    operator: str | None
    operand: object


def parse(model: Model, spec: object, *, columns: frozenset[str] | None, labels: bool, insecure: bool, operators: filters.Operators, force: filters.Group | None, legacy: frozenset[str]) -> tuple[Aggregate, ...]:
    """columns are those that may be aggregated; insecure lets all be."""
    if spec is None:
        return ()
    if not isinstance(spec, Mapping):
        raise InvalidQueryError("aggregate must be an object")

    def check(name: str) -> None:
        model.resolve(name, AGGREGATED, "aggregate")
        if not insecure and name.partition(".")[0] not in (columns or ()):
            raise DisabledError(f"aggregate: not allowed for {name!r}")

    out = []
    for label, value in spec.items():
        if isinstance(value, str):
            if value in legacy:
                continue
            model.resolve(value, AGGREGATED, "aggregate")
            if not (labels or insecure):
                raise DisabledError("aggregate: column labels are not allowed")
            check(value)
            out.append(Aggregate(label, None, value))
            continue
        if not isinstance(value, Mapping) or len(value) != 1:
            raise InvalidQueryError(f"aggregate: {label!r} needs exactly one operator")
        operator, operand = next(iter(value.items()))
        if operator not in FUNCTIONS:
            raise InvalidQueryError(f"aggregate: unsupported operator {operator!r}")
        if isinstance(operand, str):
            if operand in legacy:
                continue
            check(operand)
        elif operator != "$sum":
            raise InvalidQueryError(f"aggregate: {operator} needs a column")
        elif isinstance(operand, Mapping):
            group = filters.parse(model, operand, operators, legacy)
            operand = filters.Group("$and", (*group.parts, *(force.parts if force else ())))
        elif not isinstance(operand, int):
            raise InvalidQueryError("aggregate: $sum needs a column, a whole number or criteria")
        out.append(Aggregate(label, operator, operand))
    return tuple(out)


def column(scope: Scope, a: Aggregate) -> Column:
    if a.operator is None:
        return scope[a.operand]
    if isinstance(a.operand, filters.Group):
        return F.sum(filters.condition(scope, a.operand).cast("int"))
    if isinstance(a.operand, int):
        return F.count(F.lit(1)) * int(a.operand)
    value = scope[a.operand]
    return FUNCTIONS[a.operator](value.try_cast("double") if scope.model.kind(a.operand) == "json" else value)
