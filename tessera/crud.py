"""CRUD helpers: validated changes as DataFrames and change sets. Nothing is written; that is the caller's."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidColumnError, InvalidQueryError
from .model import Frames, Model
from .plans.policy import Settings
from .query import ENTITIES, SCALAR, Query, pluck
from .sources import by_keys, few

ABSENT = object()


class NoResultFound(LookupError):
    pass


class MultipleResultsFound(LookupError):
    pass


@dataclass
class Change:
    """What is to be done with one row: the row before and after, and what save hooks returned for relations."""

    kind: str
    before: dict | None
    after: dict | None
    relations: dict[str, object] = field(default_factory=dict)

    @property
    def changed(self) -> dict:
        """name -> (old, new) of the columns that differ."""
        old, new = self.before or {}, self.after or {}
        return {n: (old.get(n), new.get(n)) for n in {**old, **new} if old.get(n) != new.get(n)}


class CrudHelper:
    """Queries a model and turns dictionaries into rows of it."""

    def __init__(self, model: Model, **settings):
        self.model, self.settings = model, Settings(settings)
        self.settings.check(model)

    # fields

    def writable(self) -> set[str]:
        return set(self.model.columns) | set(self.model.writable)

    def _fields(self, values: Mapping, what: str) -> dict:
        if not isinstance(values, Mapping):
            raise InvalidQueryError(f"{what}: must be an object")
        legacy = self.settings.legacy()
        out = {}
        for name, value in values.items():
            if name in legacy:
                continue
            if name not in self.writable():
                raise InvalidColumnError(self.model.name, str(name), what)
            out[name] = value
        return out

    # queries

    def query_model(self, query_object: Mapping | None, source: Frames | DataFrame) -> Query:
        q = Query(self.model, self.settings)
        q = q.from_df(source) if isinstance(source, DataFrame) else q.using(source)
        return q.query(**(query_object or {}))

    # changes

    def _value(self, name: str, value: object) -> object:
        return json.dumps(value) if name in self.model.json and isinstance(value, (dict, list)) else value

    def _row(self, values: Mapping) -> dict:
        return {n: self._value(n, values.get(n)) for n in self.model.columns}

    def create_model(self, values: Mapping, spark: SparkSession) -> DataFrame:
        """One new row with the model's schema; columns without a value are null."""
        row = self._row(self._fields(values, "create"))
        return spark.createDataFrame([tuple(row.values())], T.StructType([T.StructField(f.name, f.dataType) for f in self.model.schema.fields]))

    def updated(self, before: Mapping, values: Mapping) -> dict:
        """A row after an update. An object for a JSON column is merged into an old object, one level deep; any other old
        value (null, an array, a scalar, text that is no JSON) is replaced by it."""
        after = dict(before)
        for name, value in self._fields(values, "update").items():
            if name in self.model.json and isinstance(value, Mapping):
                try:
                    old = json.loads(before.get(name) or "{}")
                except ValueError:
                    old = None
                value = {**old, **value} if isinstance(old, dict) else dict(value)
            after[name] = self._value(name, value)
        return after

    def update_model(self, values: Mapping, rows: DataFrame) -> DataFrame:
        """All given rows after the same update, as Column operations."""
        out = rows
        for name, value in self._fields(values, "update").items():
            kind = self.model.columns[name]
            if name in self.model.json and isinstance(value, Mapping):
                out = out.withColumn(name, self._json_merged(F.col(name), value))
            else:
                out = out.withColumn(name, F.lit(self._value(name, value)).cast(kind))
        return out

    @staticmethod
    def _json_merged(column, new: Mapping):
        """Shallow merge of JSON text: a variant's fields that are not in new, then new's. What is no object has no fields."""
        fresh = json.dumps(dict(new))
        old = F.coalesce(F.from_json(column, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
        kept = F.map_filter(old, lambda k, v: ~k.isin(list(new)))
        text = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(": "), F.to_json(e["value"]))), ", ")
        inner = fresh[1:-1]
        return F.concat(F.lit("{"), text, F.when(text != "", F.lit(", ")).otherwise(F.lit("")) if inner else F.lit(""), F.lit(inner + "}"))

    def upsert_many(self, many: list[Mapping], rows: DataFrame, ignore_missing: bool = False) -> DataFrame:
        """(ordinal, change, columns): each given object as a new row, an update of the row with its key, or not_found.

        The batch is one request: its keys pick the table's rows by a semi-join, and only those are joined to it.
        """
        keys, spark = self.model.primary_key, rows.sparkSession
        fields = [T.StructField(f"__n_{f.name}", f.dataType) for f in self.model.schema.fields]
        given = [self._fields(x, "upsert") for x in many]
        data = [(i, sorted(x), *[self._value(n, x.get(n)) for n in self.model.columns]) for i, x in enumerate(given)]
        batch = spark.createDataFrame(data, T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("__given", T.ArrayType(T.StringType())), *fields]))
        wanted = batch.select(*[F.col(f"__n_{k}").alias(k) for k in keys]).distinct()
        near = rows.join(few(wanted, len(many)), list(keys), "left_semi").withColumn("__found", F.lit(True))
        condition = reduce(lambda a, b: a & b, [F.col(f"__n_{k}") == near[k] for k in keys])
        found = batch.join(near, condition, "left")
        complete = F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), "__given")) == 0
        kind = F.when(F.col("__found"), "update").when(complete, "not_found").otherwise("create")
        columns = [F.when(F.array_contains("__given", n), F.col(f"__n_{n}")).otherwise(near[n]).alias(n) for n in self.model.columns]
        out = found.select("ordinal", kind.alias("change"), *columns)
        return out.where("change <> 'not_found'") if ignore_missing else out


class StrictCrudHelper(CrudHelper):
    """ro fields are never written, const fields only when a row is created; query_defaults lie under users' query objects."""

    def __init__(self, model: Model, *, ro_fields=(), rw_fields=None, const_fields=(), query_defaults: Mapping | None = None, **settings):
        super().__init__(model, **settings)
        everything = self.writable()
        for name in [*ro_fields, *(rw_fields or ()), *const_fields]:
            if name not in everything and name not in model.attributes and name not in model.relations:
                raise InvalidColumnError(model.name, name, "fields")
        self.const_fields = frozenset(const_fields)
        self.ro_fields = frozenset(everything - set(rw_fields) - self.const_fields) if rw_fields is not None else frozenset(ro_fields)
        self.query_defaults = dict(query_defaults or {})
        Query(model, self.settings).query(**self.query_defaults)

    def query_model(self, query_object, source):
        return super().query_model({**self.query_defaults, **(query_object or {})}, source)

    def _fields(self, values, what):
        out = super()._fields(values, what)
        drop = self.ro_fields | (self.const_fields if what == "update" else frozenset())
        return {k: v for k, v in out.items() if k not in drop}


def saves_relations(*names: str) -> Callable:
    """Marks a view's method that saves relations: it gets (new, previous, name=value or ABSENT ...)."""

    def mark(method: Callable) -> Callable:
        method.saves = names
        return method

    return mark


class CrudView:
    """The operations of a web view: rows as dictionaries in, change sets out. Subclasses say where rows come from."""

    crudhelper: CrudHelper

    def _source(self) -> Frames:
        raise NotImplementedError

    def _get_query_object(self) -> Mapping | None:
        return None

    def _query_hook(self, query: Query) -> Query:
        """May change the query before it is bound."""
        return query

    def _save_hook(self, new: dict, previous: dict | None) -> None:
        """Called with the row as it will be and as it was."""

    ensure_loaded: tuple[str, ...] = ()

    def _rows(self) -> DataFrame:
        return self._source().of(self.crudhelper.model)

    def _query(self, rows: DataFrame | None = None, query_object: Mapping | None = None) -> Query:
        given = query_object if query_object is not None else self._get_query_object()
        q = self.crudhelper.query_model(given, self._source())
        q.root = rows
        if self.ensure_loaded and q.kind == ENTITIES:
            q.ensure_loaded(*self.ensure_loaded)
        return self._query_hook(q)

    def _one(self, key: Mapping) -> DataFrame:
        rows = self._rows()
        for name, value in key.items():
            rows = rows.where(F.col(name) == F.lit(value))
        return rows

    @staticmethod
    def _exactly_one(found: list[dict]) -> dict:
        if not found:
            raise NoResultFound("no row")
        if len(found) > 1:
            raise MultipleResultsFound("more than one row")
        return found[0]

    def method_list(self) -> int | list[dict]:
        q = self._query()
        return q.scalar() if q.kind == SCALAR else q.rows()

    def method_get(self, **key) -> dict:
        return self._exactly_one(pluck(self._query(self._one(key)).end().limit(2)))

    def _split(self, values: Mapping) -> tuple[dict, dict]:
        relations = {n for m in self._savers() for n in m.saves}
        return {k: v for k, v in values.items() if k not in relations}, {k: v for k, v in values.items() if k in relations}

    def _savers(self) -> list[Callable]:
        return [m for m in (getattr(self, n) for n in dir(type(self))) if callable(m) and hasattr(m, "saves")]

    def _change(self, kind: str, before: dict | None, after: dict | None, related: Mapping) -> Change:
        change = Change(kind, before, after)
        for saver in self._savers():
            got = saver(after, before, **{n: related.get(n, ABSENT) for n in saver.saves})
            change.relations |= {n: got for n in saver.saves if n in related}
        if after is not None:
            self._save_hook(after, before)
        return change

    def method_create(self, values: Mapping) -> Change:
        own, related = self._split(values)
        return self._change("create", None, self.crudhelper._row(self.crudhelper._fields(own, "create")), related)

    def method_update(self, values: Mapping, **key) -> Change:
        own, related = self._split(values)
        before = self._exactly_one(pluck(self._one(key).limit(2)))
        return self._change("update", before, self.crudhelper.updated(before, own), related)

    def method_delete(self, **key) -> Change:
        return self._change("delete", self._exactly_one(pluck(self._one(key).limit(2))), None, {})

    def method_create_or_update(self, values: Mapping) -> Change:
        keys = self.crudhelper.model.primary_key
        if all(values.get(k) is not None for k in keys):
            return self.method_update(values, **{k: values[k] for k in keys})
        return self.method_create(values)

    def method_create_or_update_many(self, many: list[Mapping], ignore_missing: bool = True) -> list[Change | Exception]:
        """A change or an error for each object; rows of all keys are read in one query."""
        keys = self.crudhelper.model.primary_key
        wanted = [tuple(x[k] for k in keys) for x in many if isinstance(x, Mapping) and all(x.get(k) is not None for k in keys)]
        have = {tuple(r[k] for k in keys): r for r in pluck(by_keys(self._rows(), wanted, keys))} if wanted else {}
        out: list[Change | Exception] = []
        for x in many:
            try:
                if not isinstance(x, Mapping):
                    raise InvalidQueryError("each item must be an object")
                own, related = self._split(x)
                key = tuple(x.get(k) for k in keys)
                if None in key:
                    out.append(self.method_create(x))
                elif key in have:
                    out.append(self._change("update", have[key], self.crudhelper.updated(have[key], own), related))
                elif not ignore_missing:
                    out.append(NoResultFound(f"no row {key}"))
            except (InvalidQueryError, LookupError) as e:
                out.append(e)
        return out
