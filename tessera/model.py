"""Models: what a query may name. A model is declared once and never changes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidColumnError

_TYPES = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "LONG": T.LongType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "TIMESTAMP_NTZ": T.TimestampNTZType()}


def schema(text: str) -> T.StructType:
    """A schema from 'name TYPE, name ARRAY<TYPE> ...', without a session."""

    def kind(name: str) -> T.DataType:
        return T.ArrayType(kind(name[6:-1])) if name.startswith("ARRAY<") else _TYPES[name]

    return T.StructType([T.StructField(n, kind(t.upper())) for n, t in (f.split() for f in text.split(","))])


#: Builds a derived column; the scope gives the row's columns by name and EXISTS on its relations.
Derived = Callable[["Scope"], Column]


@dataclass(frozen=True)
class Secondary:
    """The table between the two ends of a many-to-many relation; pairs are made distinct."""

    source: Callable[[SparkSession, str], DataFrame] | str
    own: tuple[tuple[str, str], ...]
    target: tuple[tuple[str, str], ...]
    where: Callable[[DataFrame], Column] | None = None


@dataclass(frozen=True)
class Relationship:
    """keys are pairs (own column, target column), empty with a secondary table. where restricts the target's rows."""

    target: str
    keys: tuple[tuple[str, str], ...] = ()
    many: bool = True
    secondary: Secondary | None = None
    where: Derived | None = None

    @property
    def own_keys(self) -> list[str]:
        return [a for a, _ in (self.secondary.own if self.secondary else self.keys)]


@dataclass(frozen=True)
class Model:
    """A named relation: columns with types, derived members by kind, relationships, a primary key."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    source: Callable[[SparkSession, str], DataFrame] | str | None = None
    json: frozenset[str] = frozenset()
    column_properties: Mapping[str, Derived] = field(default_factory=dict)
    hybrids: Mapping[str, Derived] = field(default_factory=dict)
    properties: Mapping[str, Derived] = field(default_factory=dict)
    proxies: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    relations: Mapping[str, Relationship] = field(default_factory=dict)
    writable: frozenset[str] = frozenset()
    registry: dict[str, Model] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.registry[self.name] = self

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Model) and other.name == self.name and other.registry is self.registry

    @cached_property
    def columns(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.schema.fields}

    @cached_property
    def attributes(self) -> dict[str, str]:
        """name -> kind, of all that can be projected: columns first. Derived names with _ in front are hidden."""
        out = dict.fromkeys(self.columns, "column")
        for kind, names in (("column_property", self.column_properties), ("hybrid", self.hybrids), ("property", self.properties), ("proxy", self.proxies)):
            out |= {n: kind for n in names if not n.startswith("_")}
        return out

    def target(self, relation: str) -> Model:
        return self.registry[self.relations[relation].target]

    def kind(self, name: str) -> str | None:
        """Kind of a name or dotted path: also json (column.path), related (relation.column), relation."""
        if name in self.attributes:
            return self.attributes[name]
        if name in self.relations:
            return "relation"
        head, dot, rest = name.partition(".")
        if dot and head in self.columns:
            if head in self.json:
                return "json"
            if isinstance(self.columns[head], T.StructType):
                return "struct"
        if dot and head in self.relations:
            return "related" if rest in self.target(head).columns else None
        return None

    def resolve(self, name: object, allowed: frozenset[str], where: str) -> str:
        kind = self.kind(name) if isinstance(name, str) else None
        if kind not in allowed:
            raise InvalidColumnError(self.name, str(name), where)
        return kind

    def is_array(self, name: str) -> bool:
        return isinstance(self.columns.get(name), T.ArrayType)

    def read(self, spark: SparkSession, folder: str) -> DataFrame:
        if callable(self.source):
            return self.source(spark, folder)
        return spark.read.parquet(f"{folder}/{self.source or self.name}.parquet")

    def extended(self, name: str, schema: T.StructType, source: Callable[[SparkSession, str], DataFrame] | str | None = None, **members) -> Model:
        """A model that inherits from this one: its rows are those of its own table joined to this model's by primary key.

        All members are inherited; members given here (relations, hybrids, json ...) are added or replace inherited ones.
        """
        own = Model(name, schema, self.primary_key, source, registry={})

        def joined(spark: SparkSession, folder: str) -> DataFrame:
            return self.read(spark, folder).join(own.read(spark, folder), list(self.primary_key))

        both = T.StructType([*self.schema.fields, *[f for f in schema.fields if f.name not in self.columns]])
        more = {k: {**getattr(self, k), **members.get(k, {})} for k in ("column_properties", "hybrids", "properties", "proxies", "relations")}
        return Model(name, both, self.primary_key, joined, json=self.json | members.get("json", frozenset()), writable=self.writable | members.get("writable", frozenset()), registry=self.registry, **more)

    def query(self, source: object = None, settings: Mapping | None = None, **more):
        """A query on this model; source is a DataFrame of its rows or a Frames."""
        from .query import Query

        q = Query(self, settings if settings is not None else self.configured, **more)
        return q if source is None else q.from_df(source) if isinstance(source, DataFrame) else q.using(source)

    @property
    def configured(self) -> Mapping | None:
        return _CONFIGURED.get((id(self.registry), self.name))

    def configure(self, **settings) -> Model:
        """Settings that query() uses when it gets none."""
        _CONFIGURED[id(self.registry), self.name] = settings
        return self


_CONFIGURED: dict[tuple[int, str], Mapping] = {}


class Frames:
    """Where models' rows come from: given frames by model name, or else the models' own sources."""

    def __init__(self, spark: SparkSession | None = None, folder: str = "", frames: Mapping[str, DataFrame] | None = None):
        self.spark, self.folder, self.frames = spark, folder, dict(frames or {})
        #: What turns a filter's test into a Column, if not filter.column_test.
        self.column_test: Callable | None = None

    def testing(self, column_test: Callable | None) -> Frames:
        """The same frames for a query with another way to test a column."""
        out = Frames(self.spark, self.folder, self.frames)
        out.column_test = column_test
        return out

    def of(self, model: Model) -> DataFrame:
        df = self.frames.get(model.name)
        return df if df is not None else model.read(self.spark, self.folder)

    def secondary(self, s: Secondary) -> DataFrame:
        if callable(s.source):
            return s.source(self.spark, self.folder)
        df = self.frames.get(s.source)
        return df if df is not None else self.spark.read.parquet(f"{self.folder}/{s.source}.parquet")


class Scope:
    """The row a derived column is built on."""

    def __init__(self, model: Model, frames: Frames, prefix: str = ""):
        self.model, self.frames, self.prefix = model, frames, prefix

    def __getitem__(self, name: str) -> Column:
        kind = self.model.kind(name)
        if kind in ("column", "struct"):
            return F.col(self.prefix + name)
        if kind == "json":
            from .functions.json import json_text

            return json_text(self[name.partition(".")[0]], name.split(".")[1:])
        for members in (self.model.column_properties, self.model.hybrids, self.model.properties):
            if name in members:
                return members[name](self)
        raise KeyError(name)

    def exists(self, relation: str, criteria: Mapping | None = None) -> Column:
        """EXISTS a related row that meets the criteria."""
        from .operators.filter import parse, related_exists

        target = self.model.target(relation)
        return related_exists(self, relation, parse(target, criteria or {}))
