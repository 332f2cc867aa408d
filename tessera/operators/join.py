"""join and joinf: related rows nested into their parents, or, for counts and groups, joined flat."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQueryError, InvalidRelationError
from ..model import Model, Scope
from .filter import through

#: Rows of a limited page up to which its keys are broadcast to pick the related rows.
PAGE_BROADCAST = 10_000


def read(model: Model, spec: object, where: str, legacy: frozenset[str] = frozenset()) -> dict[str, Mapping | None]:
    """relation -> nested query object, or None for a relation without one."""
    if spec is None:
        return {}
    if isinstance(spec, str):
        spec = spec.split()
    if isinstance(spec, (list, tuple)):
        spec = dict.fromkeys(spec)
    if not isinstance(spec, Mapping):
        raise InvalidQueryError(f"{where} must be a string, a list or an object")
    out = {}
    for name, nested in spec.items():
        if name in legacy:
            continue
        if name not in model.relations:
            raise InvalidRelationError(model.name, str(name), where)
        if nested is not None and not isinstance(nested, Mapping):
            raise InvalidQueryError(f"{where}: {name!r} must be null or a query object")
        out[name] = dict(nested) if nested else None
    return out


def related(scope: Scope, relation: str, child: DataFrame, parents: DataFrame | None = None, few: bool = False) -> DataFrame:
    """child with the keys of its parents as __k0, __k1 ...; a child of several parents is one row for each.

    parents, if given, are the only ones whose pairs a many-to-many relation needs; few: their keys may be broadcast.
    """
    rel = scope.model.relations[relation]
    if rel.secondary:
        only = None if parents is None else lambda pairs: only_of(parents, rel.own_keys, pairs, few)
        return through(scope, rel, child, only)
    return child.withColumns({f"__k{i}": F.col(b) for i, (_, b) in enumerate(rel.keys)})


def on(parent: DataFrame, child: DataFrame, own: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [parent[k] == child[f"{prefix}{i}"] for i, k in enumerate(own)])


def once(page: DataFrame) -> DataFrame:
    """A bounded page behind an exchange by all of its columns: as none of them can be pruned below it, the page's own plan and
    those that only need its keys have the same exchange, which Spark computes once and reuses."""
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in page.schema.fields):
        return page
    return page.repartition(1, *[F.col(f"`{c}`") for c in page.columns])


def only_of(parents: DataFrame, own: list[str], child: DataFrame, bounded: bool) -> DataFrame:
    """The children of the given parents; the keys of a bounded page are broadcast. Null keys meet each other here, so that no
    filter for them gets between the page and its exchange; they part again where rows are nested."""
    keys = parents.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(own)])
    keys = F.broadcast(keys) if bounded else keys
    return child.join(keys, reduce(lambda a, b: a & b, [child[f"__k{i}"].eqNullSafe(keys[f"__p{i}"]) for i in range(len(own))]), "left_semi")


def nest(parent: DataFrame, relation: str, own: list[str], child: DataFrame, payload: list[str], many: bool, inner: bool) -> DataFrame:
    """parent with the related rows in a column named after the relation: an array in the order of __rn, or a struct."""
    keys = [f"__k{i}" for i in range(len(own))]
    row = F.struct(*[F.col(f"`{c}`") for c in payload]) if payload else F.struct(F.lit(None).cast("void").alias("__none"))
    name = f"__j_{relation}"
    renamed = [F.col(k).alias(f"{name}{k}") for k in keys]
    if many:
        grouped = child.select(*keys, F.struct(F.col("__rn"), row.alias("row")).alias("__x")).groupBy(*keys).agg(F.sort_array(F.collect_list("__x")).alias("__x"))
        grouped = grouped.select(*renamed, F.transform("__x", lambda x: x["row"]).alias(name))
    else:
        grouped = child.select(*renamed, row.alias(name))
    joined = parent.join(grouped, reduce(lambda a, b: a & b, [parent[k] == grouped[f"{name}__k{i}"] for i, k in enumerate(own)]), "inner" if inner else "left")
    joined = joined.drop(*[f"{name}{k}" for k in keys])
    if many and not inner:
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))
    return joined
