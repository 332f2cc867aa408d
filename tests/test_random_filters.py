"""Random filter criteria, three-valued: the engine's predicate against SQL in DuckDB, on rows full of nulls."""

import random

import duckdb

from tessera import Frames, Model, Scope, schema
from tessera.operators import filter as filters

T = Model("t", schema("id BIGINT, a INT, b STRING, w ARRAY<STRING>, j STRING"), ("id",), json=frozenset({"j"}), registry={})
WORDS = ["x", "xy", "y", "z%", "_"]


def quote(v):
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def scalar(rng, column, value, cast=""):
    op = rng.choice(["$eq", "$ne", "$lt", "$lte", "$gt", "$gte", "$in", "$nin", "$exists", "null", "notnull"])
    v = value()
    sql = {"$eq": "=", "$lt": "<", "$lte": "<=", "$gt": ">", "$gte": ">="}
    if op in sql:
        return {op: v}, f"{column} {sql[op]} {quote(v)}"
    if op == "$ne":
        return {op: v}, f"{column} IS DISTINCT FROM {quote(v)}"
    if op in ("$in", "$nin"):
        vs = [value() for _ in range(rng.randrange(1, 4))]
        return {op: vs}, f"{column} {'NOT ' if op == '$nin' else ''}IN ({', '.join(map(quote, vs))})"
    if op == "$exists":
        yes = rng.choice([0, 1])
        return {op: yes}, f"{column} IS {'NOT ' if yes else ''}NULL"
    return ({"$eq": None}, f"{column} IS NULL") if op == "null" else ({"$ne": None}, f"{column} IS NOT NULL")


def has(v):
    return f"CASE WHEN w IS NULL THEN NULL WHEN list_contains(w, {quote(v)}) THEN true WHEN len(list_filter(w, lambda e: e IS NOT NULL)) < len(w) THEN NULL ELSE false END"


def array(rng):
    op = rng.choice(["$eq", "$ne", "$in", "$nin", "$all", "$size", "$exists"])
    v, vs = rng.choice(WORDS), rng.sample(WORDS, rng.randrange(1, 3))
    listed = "[" + ", ".join(map(quote, vs)) + "]"
    overlap = f"CASE WHEN w IS NOT NULL THEN list_has_any(w, {listed}) END"
    return {
        "$eq": ({"$eq": v}, has(v)), "$ne": ({"$ne": v}, f"NOT ({has(v)})"), "$in": ({"$in": vs}, overlap), "$nin": ({"$nin": vs}, f"NOT ({overlap})"),
        "$all": ({"$all": vs}, f"CASE WHEN w IS NOT NULL THEN list_has_all(w, {listed}) END"), "$size": ({"$size": 2}, "len(w) = 2") if rng.random() < 0.5 else ({"$size": 0}, "coalesce(len(w), 0) = 0"), "$exists": ({"$exists": 1}, "w IS NOT NULL"),
    }[op]


def one(rng):
    kind = rng.choice("abwj")
    if kind == "a":
        c, s = scalar(rng, "a", lambda: rng.randrange(5))
        return {"a": c}, s
    if kind == "b":
        if rng.random() < 0.3:
            p = rng.choice(WORDS)
            return {"b": {"$prefix": p}}, f"b LIKE {quote(p + '%')}"
        c, s = scalar(rng, "b", lambda: rng.choice(WORDS))
        return {"b": c}, s
    if kind == "w":
        c, s = array(rng)
        return {"w": c}, s
    op = rng.choice(["$gte", "$lt", "$ne", "$eq"])
    v = rng.randrange(4)
    sign = {"$gte": ">=", "$lt": "<", "$ne": "IS DISTINCT FROM", "$eq": "="}[op]
    return {"j.n": {op: v}}, f"TRY_CAST(j->>'$.n' AS DOUBLE) {sign} {v}"


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return one(rng)
    op = rng.choice(["$and", "$or", "$nor", "$not"])
    parts = [tree(rng, depth - 1) for _ in range(1 if op == "$not" else rng.randrange(1, 4))]
    joined = (" AND " if op in ("$and", "$not") else " OR ").join(f"({s})" for _, s in parts)
    criteria = {op: parts[0][0] if op == "$not" else [c for c, _ in parts]}
    return criteria, f"NOT ({joined})" if op in ("$nor", "$not") else joined


def test_random_filters(spark):
    rng = random.Random(11)
    null = lambda v, p=0.3: None if rng.random() < p else v
    rows = [(i, null(rng.randrange(5)), null(rng.choice(WORDS)), null([null(x, 0.2) for x in rng.sample(WORDS, rng.randrange(4))]), null('{"n": %s}' % rng.choice(["1", "2.5", "null", '"3"', '"q"']))) for i in range(300)]
    df = spark.createDataFrame(rows, T.schema)
    cases = [tree(rng, 3) for _ in range(120)]
    scope = Scope(T, Frames(spark))
    got = df.orderBy("id").select(*[filters.condition(scope, filters.parse(T, c)).alias(f"c{k}") for k, (c, _) in enumerate(cases)]).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, a INT, b VARCHAR, w VARCHAR[], j VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT {', '.join(f'({s})' for _, s in cases)} FROM t ORDER BY id").fetchall()
    for k, (criteria, sql) in enumerate(cases):
        assert [r[k] for r in got] == [r[k] for r in want], (criteria, sql)
