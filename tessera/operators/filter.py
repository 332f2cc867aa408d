"""filter: criteria on columns, JSON paths, arrays, derived members, association proxies and related columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQueryError
from ..functions.json import as_text, typed
from ..functions.predicates import ARRAY, LISTS, SCALAR
from ..model import Model, Scope

FILTERABLE = frozenset({"column", "json", "struct", "column_property", "hybrid", "proxy", "related"})


@dataclass(frozen=True)
class Test:
    """One operator on one name."""

    name: str
    kind: str
    operator: str
    operand: object
    function: Callable


@dataclass(frozen=True)
class Group:
    """AND ($and), OR ($or), NOT OR ($nor) or NOT AND ($not) of tests and groups."""

    operator: str
    parts: tuple


@dataclass(frozen=True)
class Operators:
    """The tables of operators; built-in ones win over a query's own."""

    scalar: Mapping = field(default_factory=dict)
    array: Mapping = field(default_factory=dict)

    def find(self, array: bool, name: str):
        own, table = (self.array, ARRAY | _ADDED_ARRAY) if array else (self.scalar, SCALAR | _ADDED_SCALAR)
        if name in table:
            return table[name]
        if name in own:
            f = own[name]
            return lambda c, lit, v: f(c, lit(v) if not isinstance(v, (list, dict)) else None, v)
        return None


_ADDED_SCALAR: dict = {}
_ADDED_ARRAY: dict = {}


def add_scalar_operator(name: str, function: Callable[[Column, Column, object], Column]) -> None:
    """Adds an operator for all queries: function(column, operand as a literal, operand)."""
    _ADDED_SCALAR[name] = lambda c, lit, v: function(c, lit(v) if not isinstance(v, (list, dict)) else None, v)


def add_array_operator(name: str, function: Callable[[Column, Column, object], Column]) -> None:
    _ADDED_ARRAY[name] = lambda c, lit, v: function(c, lit(v) if not isinstance(v, (list, dict)) else None, v)


def parse(model: Model, criteria: Mapping | None, operators: Operators = Operators(), legacy: frozenset[str] = frozenset()) -> Group:
    """Criteria as a $and group; raises InvalidQueryError."""
    if criteria is None:
        criteria = {}
    if not isinstance(criteria, Mapping):
        raise InvalidQueryError("filter: criteria must be an object")
    parts: list = []
    for name, condition in criteria.items():
        if name in ("$and", "$or", "$nor"):
            if not isinstance(condition, (list, tuple)) or not condition:
                raise InvalidQueryError(f"filter: {name} needs a list of objects")
            parts.append(Group(name, tuple(parse(model, c, operators, legacy) for c in condition)))
        elif name == "$not":
            if not isinstance(condition, Mapping):
                raise InvalidQueryError("filter: $not needs an object")
            parts.append(Group("$not", parse(model, condition, operators, legacy).parts))
        elif isinstance(name, str) and (name in legacy or name.partition(".")[0] in legacy):
            continue
        else:
            parts += _tests(model, name, condition, operators)
    return Group("$and", tuple(parts))


def _tests(model: Model, name: str, condition: object, operators: Operators) -> list[Test]:
    kind = model.resolve(name, FILTERABLE, "filter")
    if not isinstance(condition, Mapping):
        condition = {"$eq": condition}
    array = (kind == "column" and model.is_array(name)) or (kind == "related" and model.target(name.partition(".")[0]).is_array(name.partition(".")[2]))
    out = []
    for operator, operand in condition.items():
        function = operators.find(array, operator)
        if function is None:
            raise InvalidQueryError(f"filter: unsupported operator {operator!r} for {'array' if array else 'scalar'} {name!r}")
        if operator in LISTS and not isinstance(operand, (list, tuple)):
            raise InvalidQueryError(f"filter: {operator} needs a list")
        if isinstance(operand, tuple):
            operand = list(operand)
        if isinstance(operand, Mapping) and operator in SCALAR | ARRAY:
            raise InvalidQueryError(f"filter: {operator} can't take an object")
        out.append(Test(name, kind, operator, operand, function))
    return out


def _literal(kind: T.DataType | None) -> Callable[[object], Column]:
    """Operands get the column's type where Spark would not find it, as for dates given as text."""
    item = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(item, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType)) or isinstance(kind, T.ArrayType):
        return lambda v: F.lit(v).cast(item)
    return F.lit


def column_test(scope: Scope, test: Test) -> Column:
    """One operator on one member of the row as a Column; a query's own handlers may replace it."""
    if test.kind == "json":
        text = scope[test.name]
        if isinstance(test.operand, list):
            return test.function(text, lambda v: F.lit(as_text(v)), test.operand)
        if test.operator in ("$exists", "$prefix"):
            return test.function(text, F.lit, test.operand)
        return test.function(typed(text, test.operand), lambda v: F.lit(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else F.lit(v), test.operand)
    return test.function(scope[test.name], _literal(scope.model.columns.get(test.name)), test.operand)


def _split(scope: Scope, parts: tuple) -> tuple[list, dict[str, list[Test]], list[tuple[str, Test]]]:
    """(tests and groups on the row itself, related tests by relation, tests on association proxies)."""
    own, related, proxies = [], {}, []
    for p in parts:
        if isinstance(p, Test) and p.kind == "related":
            relation, _, column = p.name.partition(".")
            related.setdefault(relation, []).append(Test(column, "column", p.operator, p.operand, p.function))
        elif isinstance(p, Test) and p.kind == "proxy":
            relation, column = scope.model.proxies[p.name]
            proxies.append((relation, Test(column, "column", p.operator, p.operand, p.function)))
        else:
            own.append(p)
    return own, related, proxies


def condition(scope: Scope, group: Group) -> Column:
    """A group as one Column; related tests become EXISTS, one for each relation and AND-group."""
    if group.operator in ("$or", "$nor"):
        both = reduce(lambda a, b: a | b, [condition(scope, p) for p in group.parts])
        return both if group.operator == "$or" else ~both
    own, related, proxies = _split(scope, group.parts)
    test = scope.frames.column_test or column_test
    parts = [condition(scope, p) if isinstance(p, Group) else test(scope, p) for p in own]
    parts += [related_exists(scope, r, Group("$and", tuple(tests))) for r, tests in related.items()]
    parts += [related_exists(scope, r, Group("$and", (t,))) for r, t in proxies]
    both = reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)
    return ~both if group.operator == "$not" else both


def apply(scope: Scope, df: DataFrame, group: Group, more: tuple[Column, ...] = ()) -> DataFrame:
    """df's rows that meet the group: semi-joins for related tests, then one predicate for all others."""
    own, related, proxies = _split(scope, group.parts)
    for relation, tests in [*related.items(), *[(r, [t]) for r, t in proxies]]:
        keys, child = related_rows(scope, relation, Group("$and", tuple(tests)))
        df = df.join(child, reduce(lambda a, b: a & b, [df[k] == child[f"__r{i}"] for i, k in enumerate(keys)]), "left_semi")
    if own or more:
        df = df.where(reduce(lambda a, b: a & b, [condition(scope, Group("$and", tuple(own))), *more]) if own else reduce(lambda a, b: a & b, more))
    return df


def related_rows(scope: Scope, relation: str, group: Group) -> tuple[list[str], DataFrame]:
    """(own key columns, frame with the keys of matching related rows as __r0, __r1 ...)."""
    rel, target = scope.model.relations[relation], scope.model.target(relation)
    inner = Scope(target, scope.frames)
    child = scope.frames.of(target)
    more = (rel.where(inner),) if rel.where else ()
    child = apply(inner, child, group, more)
    if rel.secondary:
        child = through(scope, rel, child)
        return rel.own_keys, child.select(*[F.col(f"__k{i}").alias(f"__r{i}") for i in range(len(rel.own_keys))])
    return rel.own_keys, child.select(*[F.col(b).alias(f"__r{i}") for i, (_, b) in enumerate(rel.keys)])


def through(scope: Scope, rel, child: DataFrame, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """child joined to its secondary table, whose rows `only` may restrict: its columns and the parents' keys as __k0, __k1 ..."""
    s = rel.secondary
    table = scope.frames.secondary(s)
    if s.where:
        table = table.where(s.where(table))
    own = [F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(s.own)]
    pairs = table.select(*own, *[F.col(a).alias(f"__t{i}") for i, (a, _) in enumerate(s.target)])
    pairs = (only(pairs) if only else pairs).distinct()
    on = reduce(lambda a, b: a & b, [pairs[f"__t{i}"] == child[b] for i, (_, b) in enumerate(s.target)])
    return child.join(pairs, on).drop(*[f"__t{i}" for i in range(len(s.target))])


def related_exists(scope: Scope, relation: str, group: Group) -> Column:
    keys, child = related_rows(scope, relation, group)
    # the alias keeps an outer name from being taken for a column that the child had before its keys were selected
    return child.alias(f"__{relation}").where(reduce(lambda a, b: a & b, [F.col(f"__r{i}") == scope[k].outer() for i, k in enumerate(keys)])).exists()
