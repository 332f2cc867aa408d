"""sort and group: lists of names with a direction."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Mapping

from pyspark.sql import Column

from ..errors import InvalidQueryError
from ..model import Model, Scope

SORTABLE = frozenset({"column", "json", "struct", "column_property", "hybrid", "proxy"})


def parse(model: Model, spec: object, where: str = "sort", legacy: frozenset[str] = frozenset()) -> dict[str, int]:
    """name -> 1 or -1, in order; of a repeated name the last direction counts."""
    if spec is None:
        return {}
    if isinstance(spec, str):
        spec = spec.split()
    if isinstance(spec, Mapping):
        if len(spec) > 1 and not isinstance(spec, OrderedDict):
            raise InvalidQueryError(f"{where}: an object may have one key only; use a list")
        pairs = list(spec.items())
    elif isinstance(spec, (list, tuple)):
        pairs = []
        for x in spec:
            if not isinstance(x, str):
                raise InvalidQueryError(f"{where}: names must be strings")
            pairs.append((x[:-1], -1 if x[-1] == "-" else 1) if x[-1:] in ("+", "-") else (x, 1))
    else:
        raise InvalidQueryError(f"{where}: must be a string, a list or an object")
    out: dict[str, int] = {}
    for name, direction in pairs:
        if isinstance(direction, bool) or direction not in (1, -1):
            raise InvalidQueryError(f"{where}: direction of {name!r} must be 1 or -1")
        if name in legacy:
            continue
        model.resolve(name, SORTABLE, where)
        out[name] = direction
    return out


def ordered(column: Column, direction: int) -> Column:
    """Nulls are the largest values: last when ascending, first when descending."""
    return column.asc_nulls_last() if direction > 0 else column.desc_nulls_first()


def sort_columns(scope: Scope, spec: Mapping[str, int]) -> list[tuple[Column, int]]:
    return [(scope[name], direction) for name, direction in spec.items()]
