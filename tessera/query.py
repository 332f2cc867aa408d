"""Queries: a query object checked against a model and its settings, and bound to DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DisabledError, InvalidColumnError, InvalidQueryError, NotLoadedError, RuntimeQueryError
from .model import Frames, Model, Scope
from .operators import aggregate as aggregates
from .operators import filter as filters
from .operators import join as joins
from .operators import limit as limits
from .operators import sort as sorts
from .operators.project import Projection
from .plans.policy import PROJECT, Settings

KEYS = ("project", "sort", "group", "filter", "join", "joinf", "aggregate", "skip", "limit", "count")
ENTITIES, TUPLES, SCALAR = "entities", "tuples", "scalar"


@dataclass(frozen=True)
class Handlers:
    """What reads each part of a query object and turns it into Columns. A subclass of Query may set its own."""

    project: Callable[..., Projection] = Projection
    filter: Callable = filters.parse
    sort: Callable = sorts.parse
    group: Callable = sorts.parse
    aggregate: Callable = aggregates.parse
    join: Callable = joins.read
    limit: Callable = limits.parse
    #: (scope, filter test) and (scope, aggregate) to a Column.
    column_test: Callable | None = None
    column_aggregate: Callable = aggregates.column


@dataclass
class Checked:
    """A query object after all checks. Only what it says is left for Spark."""

    model: Model
    settings: Settings
    given: dict
    projection: Projection
    filter: filters.Group
    sort: dict[str, int]
    group: dict[str, int]
    aggregate: tuple[aggregates.Aggregate, ...]
    skip: int
    limit: int | None
    count: bool
    join: dict[str, Checked | None] = field(default_factory=dict)
    joinf: dict[str, Checked | None] = field(default_factory=dict)
    queried: bool = False

    @property
    def kind(self) -> str:
        return SCALAR if self.count else TUPLES if self.aggregate else ENTITIES

    @property
    def has_nested(self) -> bool:
        """Whether the relation is loaded with a query of its own, or only as it is."""
        return self.queried or bool(self.settings.get("max_items") or self.settings.get("force_filter"))


def check(model: Model, settings: Settings, qo: Mapping, *, limited: bool = True, path: str = "", handlers: Handlers = Handlers()) -> Checked:
    """Parses and checks a query object with everything nested in it."""
    unknown = set(qo) - set(KEYS)
    if unknown:
        raise InvalidQueryError(f"Unknown query keys: {', '.join(sorted(map(str, unknown)))}")
    settings.check(model)
    for key in KEYS:
        handler = "limit" if key in ("skip", "limit") else key
        if qo.get(key) is not None and not settings.enabled(handler):
            raise DisabledError(f"{key} is disabled on {model.name}")
    count = qo.get("count")
    if count is not None and not isinstance(count, int):
        raise InvalidQueryError("count must be a number or a boolean")
    given = dict(qo)
    if count:
        for key in ("sort", "project", "skip", "limit", "join"):
            given.pop(key, None)
    legacy = settings.legacy()
    operators = filters.Operators(settings.get("scalar_operators") or {}, settings.get("array_operators") or {})
    forced = settings.get("force_filter")
    force = handlers.filter(model, forced, operators, legacy) if isinstance(forced, Mapping) else None
    criteria = handlers.filter(model, given.get("filter"), operators, legacy)
    if force:
        criteria = filters.Group("$and", (*criteria.parts, *force.parts))
    aggregate = handlers.aggregate(model, given.get("aggregate"), columns=frozenset(settings.get("aggregate_columns") or ()), labels=bool(settings.get("aggregate_labels")), insecure=bool(settings.get("aggregate_insecure")), operators=operators, force=force, legacy=legacy)
    sort = handlers.sort(model, given.get("sort"), "sort", legacy)
    group = handlers.group(model, given.get("group"), "group", legacy)
    most = settings.get("max_items") if limited and not count else None
    skip, limit = handlers.limit(given.get("skip"), given.get("limit"), most)
    projection = handlers.project(model, **{k: settings[k] for k in PROJECT if k in settings}, legacy=legacy, join_enabled=settings.enabled("join"))
    if not aggregate and not count:
        projection.input(given.get("project"))
    out = Checked(model, settings, given, projection, criteria, sort, group, aggregate, skip, limit, bool(count))
    if aggregate:
        keys = set(group)
        for a in aggregate:
            if a.operator is None and a.operand not in keys:
                raise InvalidQueryError(f"aggregate: {a.operand!r} must be grouped by")
        for name in sort:
            if name not in keys:
                raise InvalidQueryError(f"sort: {name!r} must be grouped by")
    elif group and not count:
        if not set(model.primary_key) <= set(group):
            raise InvalidQueryError("group without aggregate needs the primary key")
    join = handlers.join(model, given.get("join"), "join", legacy)
    joinf = handlers.join(model, given.get("joinf"), "joinf", legacy)
    if (aggregate or (group and not count)) and join:
        raise InvalidQueryError("join can't be used with aggregate or group")
    if aggregate and joinf and (skip or limit):
        raise InvalidQueryError("joinf can't be used with aggregate and a limit")
    if not aggregate and not count:
        for name, nested in projection.joined().items():
            if name not in join and name not in joinf:
                join[name] = dict(nested) if nested else None
    for name in [*join, *joinf]:
        allowed, banned = settings.get("allowed_relations"), settings.get("banned_relations")
        if (allowed is not None and name not in allowed) or (banned is not None and name in banned):
            raise DisabledError(f"Relation {name!r} of {model.name} is disabled")
    for where, names, into in (("join", join, out.join), ("joinf", joinf, out.joinf)):
        for name, nested in names.items():
            into[name] = _check_nested(model, settings, name, nested, where, f"{path}.{name}" if path else name, limited, handlers)
    return out


def _check_nested(model: Model, settings: Settings, name: str, nested: Mapping | None, where: str, path: str, limited: bool, handlers: Handlers = Handlers()) -> Checked:
    sub = settings.nested(model, name)
    target, many = model.target(name), model.relations[name].many
    banned = ("aggregate", "group", "count") if where == "join" and many else ("aggregate", "group", "count", "skip", "limit")
    for key in banned:
        if (nested or {}).get(key):
            raise InvalidQueryError(f"{where}: {key} is not possible on relation {path!r}")
    if sub.get("max_items") and (where == "joinf" or not many):
        raise ValueError(f"max_items is not possible on relation {path!r}")
    got = check(target, sub, nested or {}, limited=limited, path=path, handlers=handlers)
    got.queried = bool(nested)
    return got


class Binder:
    """Builds DataFrames from checked queries. Everything stays lazy."""

    def __init__(self, frames: Frames, handlers: Handlers = Handlers()):
        self.frames, self.handlers = frames.testing(handlers.column_test), handlers

    def base(self, q: Checked, df: DataFrame | None = None) -> tuple[Scope, DataFrame]:
        """The model's rows that meet filter and force_filter."""
        scope = Scope(q.model, self.frames)
        df = df if df is not None else self.frames.of(q.model)
        forced = q.settings.get("force_filter")
        more: tuple[Column, ...] = ()
        if callable(forced):
            got = forced(scope)
            more = tuple(got) if isinstance(got, (list, tuple)) else (got,)
        return scope, filters.apply(scope, df, q.filter, more)

    def filtering(self, q: Checked) -> dict[str, Checked]:
        """The joinf relations that restrict the parents: all but bare ones where the settings say so."""
        bare = q.settings.get("bare_joinf_filters", True)
        return {r: n for r, n in q.joinf.items() if n.has_nested or bare}

    def flat(self, scope: Scope, df: DataFrame, q: Checked) -> DataFrame:
        """df inner-joined to its joinf relations, one row for each match."""
        for name, nested in self.filtering(q).items():
            rel = q.model.relations[name]
            inner, child = self.base(nested)
            child = child.where(rel.where(inner)) if rel.where else child
            child = self.flat(inner, child, nested)
            keyed = joins.related(scope, name, child)
            keyed = keyed.select(*[F.col(f"__k{i}").alias(f"__f{i}") for i in range(len(rel.own_keys))])
            df = df.join(keyed, joins.on(df, keyed, rel.own_keys, "__f")).drop(*[f"__f{i}" for i in range(len(rel.own_keys))])
        return df

    def bind(self, q: Checked, df: DataFrame | None = None) -> DataFrame:
        scope, df = self.base(q, df)
        if q.kind == SCALAR:
            return self.flat(scope, df, q).agg(F.count(F.lit(1)).alias("count"))
        if q.kind == TUPLES:
            return self.tuples(scope, df, q)
        out, names = self.entities(scope, df, q, [], root=True)
        return out.select(*names)

    def tuples(self, scope: Scope, df: DataFrame, q: Checked) -> DataFrame:
        df = self.flat(scope, df, q)
        made = [self.handlers.column_aggregate(scope, a).alias(a.label) for a in q.aggregate if a.operator is not None]
        if not q.group:
            return limits.page(df.agg(*made), q.skip, q.limit)
        keys = {name: f"__g{i}" for i, name in enumerate(q.group)}
        grouped = df.groupBy(*[scope[n].alias(k) for n, k in keys.items()])
        out = grouped.agg(*(made or [F.count(F.lit(1)).alias("__n")]))
        if q.sort:
            out = out.orderBy(*[sorts.ordered(F.col(keys[n]), d) for n, d in q.sort.items()])
        elif q.skip or q.limit:
            out = out.orderBy(*[F.col(k).asc_nulls_last() for k in keys.values()])
        out = limits.page(out, q.skip, q.limit)
        return out.select(*[F.col(keys[a.operand]).alias(a.label) if a.operator is None else F.col(f"`{a.label}`") for a in q.aggregate])

    def entities(self, scope: Scope, df: DataFrame, q: Checked, keep: list[str], parents: list[str] | None = None, of: int | None = None, root: bool = False) -> tuple[DataFrame, list[str]]:
        """(frame, its visible columns). keep names columns that stay, as a parent needs them; parents makes the page per parent.

        of: how many parents there are at most, if only the rows of some are wanted; 0 if there is no bound, None if all rows are.
        """
        model, sort = q.model, sorts.sort_columns(scope, q.sort)
        order = {f"__s{i}": (c, d) for i, (c, d) in enumerate(sort)}
        rel_names = [*q.joinf, *q.join]
        plain = [n for n in q.projection.loaded() if model.attributes[n] != "proxy"]
        visible = [n for n in q.projection.visible() if n in model.attributes]
        keys = list(dict.fromkeys([*model.primary_key, *keep, *[k for r in rel_names for k in model.relations[r].own_keys], *[k for n in visible if model.attributes[n] == "proxy" for k in model.relations[model.proxies[n][0]].own_keys]]))
        df = df.withColumns({s: c for s, (c, _) in order.items()}) if order else df
        by = [sorts.ordered(F.col(s), d) for s, (_, d) in order.items()]
        unique = [F.col(k).asc_nulls_last() for k in model.primary_key]
        if parents is not None:
            # numbering the rows of each parent also without a page was measured to be faster than sorting arrays by several keys
            df = limits.page_per_parent(df, parents, [*by, *unique], q.skip, q.limit)
        elif q.skip or q.limit:
            df = limits.page(df.orderBy(*by, *unique), q.skip, q.limit)
        page = q.limit if root else of if of is None or parents is None else of * (q.limit or 0)
        values = {n: scope[n] for n in plain if n not in model.columns}
        df = df.withColumns({f"__v_{n}": c for n, c in values.items()}) if values else df
        extra = [c for c in df.columns if c.startswith("__")]
        df = df.select(*dict.fromkeys([*keys, *[n for n in plain if n in model.columns], *extra]))
        if root and page and page <= joins.PAGE_BROADCAST and rel_names:
            df = joins.once(df)
        filtering = self.filtering(q)
        for name, nested, inner in [*[(n, x, n in filtering) for n, x in q.joinf.items()], *[(n, x, False) for n, x in q.join.items()]]:
            df = self.nested(scope, df, q, name, nested, inner, page)
        for name in visible:
            if model.attributes[name] == "proxy":
                df = self.proxy(scope, df, name, page)
        if root and (order or page):
            df = df.orderBy(*by, *unique)
        shown = [F.col(n).alias(n) if n in model.columns else F.col(f"__p_{n}").alias(n) if model.attributes[n] == "proxy" else F.col(f"__v_{n}").alias(n) for n in visible]
        shown += [F.col(f"__j_{r}").alias(r) for r in rel_names if r not in q.projection.quiet_relations]
        return df, shown

    def nested(self, scope: Scope, df: DataFrame, q: Checked, name: str, nested: Checked, inner: bool, page: int | None) -> DataFrame:
        rel = q.model.relations[name]
        inside, child = self.base(nested)
        child = child.where(rel.where(inside)) if rel.where else child
        few = bool(page) and page <= joins.PAGE_BROADCAST
        some = page is not None or bool(q.filter.parts)
        child = joins.related(scope, name, child, df if some else None, few)
        if page is not None and not rel.secondary:
            child = joins.only_of(df, rel.own_keys, child, few)
        keys = [f"__k{i}" for i in range(len(rel.own_keys))]
        child, shown = self.entities(inside, child, nested, keys, keys if rel.many else None, page)
        payload = [f"__o{i}" for i in range(len(shown))]
        names = [nested_name for nested_name in self._names(shown, child)]
        rn = [F.col("__rn")] if rel.many else []
        child = child.select(*[F.col(k) for k in keys], *rn, *[c.alias(p) for c, p in zip(shown, payload, strict=True)])
        child = child.withColumnsRenamed(dict(zip(payload, names, strict=True)))
        return joins.nest(df, name, rel.own_keys, child, names, rel.many, inner)

    @staticmethod
    def _names(shown: list[Column], df: DataFrame) -> list[str]:
        return df.select(*shown).columns

    def proxy(self, scope: Scope, df: DataFrame, name: str, page: int | None) -> DataFrame:
        """A column of a relation's rows as a list."""
        relation, column = scope.model.proxies[name]
        target = scope.model.target(relation)
        q = check(target, Settings(), {"project": [column], "sort": [column]})
        df = self.nested(scope, df, check(scope.model, Settings(), {}), relation, q, False, page)
        return df.withColumn(f"__p_{name}", F.transform(f"__j_{relation}", lambda x: x[column])).drop(f"__j_{relation}")


class Query:
    """A query on a model: settings, a source of rows, and a query object."""

    handlers = Handlers()

    def __init__(self, model: Model, settings: Mapping | None = None, **more):
        self.model, self.settings = model, Settings(settings or {}, **more)
        self.settings.check(model)
        self.frames, self.root, self.limited, self.qo, self.additions = None, None, True, {}, []
        self.checked: Checked | None = None

    # where rows come from

    def using(self, frames: Frames) -> Query:
        self.frames = frames
        return self

    def with_session(self, spark: SparkSession, folder: str = "", frames: Mapping[str, DataFrame] | None = None) -> Query:
        return self.using(Frames(spark, folder, frames))

    def from_df(self, df: DataFrame) -> Query:
        """Starts from prepared rows of the model."""
        self.root = df
        self.frames = self.frames or Frames(df.sparkSession)
        return self

    def aliased(self, name: str) -> Query:
        """Rows under an alias; nested frames never clash, so this only names the plan's root."""
        self.root = (self.root if self.root is not None else self.frames.of(self.model)).alias(name)
        return self

    def options(self, no_limit_offset: bool = False) -> Query:
        self.limited = not no_limit_offset
        return self

    # what is asked

    def query(self, **qo) -> Query:
        self.qo = qo
        self._check()
        return self

    def _check(self) -> None:
        qo = dict(self.qo)
        if not self.limited:
            qo.pop("skip", None), qo.pop("limit", None)
        self.checked = check(self.model, self.settings, qo, limited=True, handlers=self.handlers)
        if not self.limited:
            self.checked.skip, self.checked.limit = 0, None

    def _ready(self) -> Checked:
        if self.checked is None:
            self._check()
        return self.checked

    def merge(self, quietly: bool = False, strict: bool = True, **qo) -> Query:
        """Adds to a query: filter and sort keys are added, projections and relations merged."""
        old = self._ready()
        for key, spec in qo.items():
            if key == "filter":
                self.qo["filter"] = {"$and": [c for c in (self.qo.get("filter"), spec) if c]}
            elif key == "sort":
                had = sorts.parse(self.model, self.qo.get("sort"))
                if had and strict:
                    raise InvalidQueryError("sort is already given")
                self.qo["sort"] = [f"{n}{'+' if d > 0 else '-'}" for n, d in (had | sorts.parse(self.model, spec)).items()]
            elif key == "project":
                old.projection.merge(spec, quietly)
                self.additions.append((spec, quietly))
            elif key == "join":
                self.qo["join"] = _merge_joins(self.model, self.qo.get("join"), spec, quietly, strict)
                if quietly:
                    self.additions.append(({r: 1 for r in joins.read(self.model, spec, "join") if r not in old.join}, True))
            else:
                raise InvalidQueryError(f"{key} can't be merged")
        self._check()
        for spec, quiet in self.additions:
            self.checked.projection.merge(spec, quiet)
            for name, nested in self.checked.projection.joined().items():
                if name not in self.checked.join and name not in self.checked.joinf:
                    self.checked.join[name] = _check_nested(self.model, self.settings, name, nested, "join", name, True, self.handlers)
        return self

    def ensure_loaded(self, *names: str, limits_allowed: bool = False) -> Query:
        """Has columns and relations loaded without showing them."""
        if self._ready().kind != ENTITIES:
            raise InvalidQueryError("ensure_loaded needs a query for entities")
        for name in names:
            have = self.checked.join.get(name)
            if have is not None and not limits_allowed and (have.filter.parts or have.skip or have.limit):
                raise InvalidQueryError(f"Relation {name!r} is loaded with a filter")
        plain = [n for n in names if "." not in n]
        for n in plain:
            if self.model.kind(n) is None:
                raise InvalidColumnError(self.model.name, n, "ensure_loaded")
        return self.merge(quietly=True, project=plain)

    # what comes out

    @property
    def kind(self) -> str:
        return self._ready().kind

    def end(self) -> DataFrame:
        """The lazy result: entities with nested relations, grouped rows, or a count."""
        try:
            return Binder(self.frames, self.handlers).bind(self._ready(), self.root)
        except PySparkException as e:
            raise RuntimeQueryError(f"{self.model.name}: {e}") from e

    def end_count(self) -> Counted:
        """The result together with the number of rows without skip and limit."""
        q = self._ready()
        if q.kind != ENTITIES:
            raise InvalidQueryError("end_count needs a query for entities")
        binder = Binder(self.frames, self.handlers)
        scope, df = binder.base(q, self.root)
        for name, nested in binder.filtering(q).items():
            rel = self.model.relations[name]
            inside, child = binder.base(nested)
            child = child.where(rel.where(inside)) if rel.where else child
            child = joins.related(scope, name, binder.flat(inside, child, nested))
            keyed = child.select(*[F.col(f"__k{i}").alias(f"__f{i}") for i in range(len(rel.own_keys))])
            df = df.join(keyed, joins.on(df, keyed, rel.own_keys, "__f"), "left_semi")
        return Counted(self.end(), df.agg(F.count(F.lit(1)).alias("count")), q)

    def rows(self) -> list[dict]:
        """The result as nested dictionaries; where settings say so, reading a name that was not loaded raises."""
        return guarded(pluck(self.end()), self._ready())

    def scalar(self) -> int:
        return self.end().first()[0]

    def __contains__(self, name: str) -> bool:
        q = self._ready()
        return name in q.projection or name in q.join or name in q.joinf

    @property
    def projection(self) -> dict:
        q = self._ready()
        if q.kind == TUPLES:
            return {a.label: 1 for a in q.aggregate}
        return q.projection.projection | {r: 1 for r in [*q.join, *q.joinf] if r not in q.projection.quiet_relations}

    def full_projection(self) -> dict:
        q = self._ready()
        return q.projection.full() | {r: int(r in q.join or r in q.joinf) for r in self.model.relations}

    def projection_tree(self, full: bool = False) -> dict:
        def tree(q: Checked) -> dict:
            own = q.projection.full() if full else q.projection.projection
            return own | {r: tree(n) for r, n in (q.join | q.joinf).items() if r not in q.projection.quiet_relations}

        return tree(self._ready())

    def final_query_object(self) -> dict:
        """The query object after defaults and settings, relations included."""

        def final(q: Checked) -> dict:
            out = {k: v for k, v in q.given.items() if v is not None and k not in ("join", "joinf", "skip", "limit")}
            if q.kind == ENTITIES:
                out["project"] = q.projection.full()
            out |= {k: v for k, v in (("skip", q.skip), ("limit", q.limit)) if v}
            for key, names in (("join", q.join), ("joinf", q.joinf)):
                if names:
                    out[key] = {r: final(n) for r, n in names.items()}
            return out

        return final(self._ready())


def _merge_joins(model: Model, old: object, new: object, quietly: bool, strict: bool) -> dict:
    out = joins.read(model, old, "join")
    for name, nested in joins.read(model, new, "join").items():
        if name not in out or out[name] is None or nested is None:
            out[name] = out.get(name) if nested is None else nested
            continue
        had, target = dict(out[name]), model.target(name)
        mergeable = {"project", "join", "sort"} | (set() if strict else {"filter"})
        for q in (had, nested):
            if strict and set(q) - mergeable:
                raise InvalidQueryError(f"join: {name!r} can't be merged")
        if had.get("sort") and nested.get("sort") and strict:
            raise InvalidQueryError(f"join: {name!r} is sorted twice")
        if "project" in nested:
            both = Projection(target).input(had.get("project")).merge(nested["project"], quietly)
            had["project"] = both.projection
        if "join" in nested:
            had["join"] = _merge_joins(target, had.get("join"), nested["join"], quietly, strict)
        if "filter" in nested:
            had["filter"] = {"$and": [c for c in (had.get("filter"), nested["filter"]) if c]}
        if nested.get("sort"):
            had["sort"] = nested["sort"]
        out[name] = had
    return out


class Counted:
    """Rows and their total without skip and limit; both are computed when first asked for, in any order."""

    def __init__(self, df: DataFrame, total: DataFrame, q: Checked):
        self.df, self._total, self._q = df, total, q

    @cached_property
    def count(self) -> int:
        return self._total.first()[0]

    @cached_property
    def _rows(self) -> list[dict]:
        return guarded(pluck(self.df), self._q)

    def __iter__(self) -> Iterator[dict]:
        return iter(self._rows)

    def with_total(self, name: str = "total") -> DataFrame:
        """The rows with the total in a column; the count is a scalar subquery, not a window over everything."""
        return self.df.withColumn(name, self._total.scalar())


class Guarded(dict):
    """A result row that tells names that were not loaded from names that don't exist."""

    def __init__(self, row: Mapping, model: Model, banned: frozenset[str]):
        super().__init__(row)
        self.model, self.banned = model, banned

    def __missing__(self, name: str):
        raise NotLoadedError(self.model.name, name) if name in self.banned else KeyError(name)

    def get(self, name: str, default=None):
        return self[name] if name in self or name in self.banned else default


def guarded(rows: list[dict], q: Checked) -> list[dict]:
    """rows as Guarded ones wherever the settings of the model or of a relation ask for it."""
    if q.kind != ENTITIES:
        return rows
    columns, relations = q.settings.raising()
    banned = frozenset([*(q.model.attributes if columns else ()), *(q.model.relations if relations else ())])

    def inside(value, nested: Checked):
        return value if value is None else guarded(value, nested) if isinstance(value, list) else guarded([value], nested)[0]

    loaded = {**q.join, **q.joinf}
    out = [{k: inside(v, loaded[k]) if k in loaded else v for k, v in row.items()} for row in rows]
    return [Guarded(row, q.model, banned) for row in out] if banned else out


def pluck(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


