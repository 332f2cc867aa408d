"""Registered queries of the engine on the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crud import CrudHelper, CrudView, StrictCrudHelper
from .model import Frames, Model
from .models_tpch import Customer, Events, Lineitem, Nation, Orders, Part, Region
from .operators.filter import column_test
from .operators.project import Projection
from .plans.policy import Settings
from .query import Handlers, Query
from .sources import by_keys, json_lines

OPEN = {"aggregate_insecure": True}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# What the models derive, for the SQL side.
PART = "(SELECT *, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split(p_name, ' '), lambda x: nullif(x, 'cold')) END AS words FROM part)"
CUST = "(SELECT *, nullif(c_nationkey, 3) AS nation_or_null, CAST(floor(c_acctbal / 1000) AS INT) AS balance_band FROM customer)"
EVENTS = "(SELECT *, event_id % 50 AS n, event_id % 3 = 0 AS big, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 9 END AS v, event_id % 5 AS l0, event_id % 7 AS l1 FROM events)"


def ask(model: Model, spark: SparkSession, folder: str, qo: dict, settings: dict | None = None) -> Query:
    return Query(model, settings or {}).using(Frames(spark, folder)).query(**qo)


def add(key: str, model: Model, qo: dict, sql: str | None, settings: dict | None = None, then=None) -> None:
    """Registers a query object; then turns the result into the flat rows that SQL returns."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = ask(model, spark, folder, qo, settings).end()
        return then(df) if then else df

    QUERIES[key] = run
    if sql:
        ORACLES[key] = sql


def where(key: str, model: Model, criteria: dict, columns: str, table: str, predicate: str, settings: dict | None = None) -> None:
    add(key, model, {"project": columns.split(), "filter": criteria}, f"SELECT {', '.join(columns.split())} FROM {table} WHERE {predicate}", settings)


# filters on scalars
C, P, E = "c_custkey c_name", "p_partkey p_name", "event_id"
where("f_eq", Customer, {"nation_or_null": 5}, C, CUST, "nation_or_null = 5")
where("f_eq_null", Customer, {"nation_or_null": None}, C, CUST, "nation_or_null IS NULL")
where("f_ne_null", Customer, {"nation_or_null": {"$ne": 5}}, C, CUST, "nation_or_null IS DISTINCT FROM 5")
where("f_cmp", Customer, {"c_acctbal": {"$gte": 100, "$lt": 5000}, "nation_or_null": {"$gt": 2, "$lte": 20}}, C, CUST, "c_acctbal >= 100 AND c_acctbal < 5000 AND nation_or_null > 2 AND nation_or_null <= 20")
where("f_prefix", Part, {"p_name": {"$prefix": "c"}}, P, "part", "p_name LIKE 'c%'")
where("f_in", Customer, {"nation_or_null": {"$in": [1, 3, 5]}}, C, CUST, "nation_or_null IN (1, 3, 5)")
where("f_nin_null", Customer, {"nation_or_null": {"$nin": [1, 5]}}, C, CUST, "nation_or_null NOT IN (1, 5)")
where("f_exists", Customer, {"nation_or_null": {"$exists": 1}}, C, CUST, "nation_or_null IS NOT NULL")
where("f_date", Orders, {"o_orderdate": {"$lt": "1995-03-15"}}, "o_orderkey o_orderpriority", "orders", "o_orderdate < TIMESTAMP '1995-03-15'")
# filters on arrays
where("f_arr_contains", Part, {"words": "hot"}, P, PART, "list_contains(words, 'hot')")
where("f_arr_eq", Part, {"words": ["hot", "bolt"]}, P, PART, "words = ['hot', 'bolt']")
where("f_arr_ne", Part, {"words": {"$ne": "hot"}}, P, PART, "CASE WHEN words IS NULL THEN NULL WHEN list_contains(words, 'hot') THEN false WHEN len(list_filter(words, lambda x: x IS NOT NULL)) < len(words) THEN NULL ELSE true END")
where("f_arr_in", Part, {"words": {"$in": ["hot", "red"]}}, P, PART, "list_has_any(words, ['hot', 'red'])")
where("f_arr_nin", Part, {"words": {"$nin": ["hot", "red"]}}, P, PART, "words IS NOT NULL AND NOT coalesce(list_has_any(words, ['hot', 'red']), false)")
where("f_arr_exists", Part, {"words": {"$exists": 0}}, P, PART, "words IS NULL")
where("f_arr_all", Part, {"words": {"$all": ["hot"]}}, P, PART, "list_has_all(words, ['hot'])")
where("f_arr_size", Part, {"words": {"$size": 2}}, P, PART, "len(words) = 2")
where("f_arr_size0_null", Part, {"words": {"$size": 0}}, P, PART, "coalesce(len(words), 0) = 0")
# boolean operators
where("f_and", Orders, {"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 100000}}]}, "o_orderkey", "orders", "o_orderstatus = 'F' AND o_totalprice > 100000")
where("f_or", Orders, {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 300000}}]}, "o_orderkey", "orders", "o_orderstatus = 'P' OR o_totalprice > 300000")
where("f_nor", Customer, {"$nor": [{"nation_or_null": 5}, {"c_mktsegment": "BUILDING"}]}, C, CUST, "NOT (nation_or_null = 5 OR c_mktsegment = 'BUILDING')")
where("f_not", Customer, {"$not": {"nation_or_null": 5}}, C, CUST, "NOT (nation_or_null = 5)")
where("f_nested_bool", Customer, {"c_acctbal": {"$gt": 0}, "$or": [{"$and": [{"nation_or_null": {"$lt": 9}}, {"c_mktsegment": "BUILDING"}]}, {"$not": {"$nor": [{"nation_or_null": 11}]}}]}, C, CUST, "c_acctbal > 0 AND ((nation_or_null < 9 AND c_mktsegment = 'BUILDING') OR NOT (NOT (nation_or_null = 11)))")
where("f_implicit_and", Orders, {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}, "o_orderkey", "orders", "o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
# extensions and policy
where("f_custom_search", Customer, {"c_name": {"$search": "0012"}}, C, "customer", "c_name ILIKE '%0012%'", {"scalar_operators": {"$search": lambda c, lit, v: c.ilike(f"%{v}%")}})
where("f_custom_array", Part, {"words": {"$last": "bolt"}}, P, PART, "words[-1] = 'bolt'", {"array_operators": {"$last": lambda c, lit, v: F.try_element_at(c, F.lit(-1)) == lit}})
where("f_force_filter", Customer, {"c_acctbal": {"$gt": 0}}, C, "customer", "c_acctbal > 0 AND c_nationkey = 7", {"force_filter": {"c_nationkey": 7}})
where("f_force_filter_fn", Customer, {"c_acctbal": {"$gt": 0}}, C, "customer", "c_acctbal > 0 AND c_nationkey < 7", {"force_filter": lambda s: s["c_nationkey"] < 7})
where("f_column_property", Customer, {"balance_band": {"$in": [1, 2]}}, C, CUST, "balance_band IN (1, 2)")
where("f_hybrid", Customer, {"rich": True}, C, "customer", "c_acctbal > 5000")
where("f_hybrid_exists", Customer, {"has_big_order": True}, C, "customer", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
where("f_proxy", Customer, {"order_statuses": {"$in": ["P"]}}, C, "customer", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
where("f_legacy", Customer, {"gone": 1, "c_nationkey": 4}, C, "customer", "c_nationkey = 4", {"legacy_fields": ["gone"]})
# JSON
where("f_json_cmp", Events, {"props.k": {"$gte": 50}}, E, "events", "CAST(props->>'$.k' AS DOUBLE) >= 50")
where("f_json_eq_text", Events, {"props.k": "7"}, E, "events", "props->>'$.k' = '7'")
where("f_json_bool", Events, {"doc.big": True}, E, EVENTS, "big")
where("f_json_null", Events, {"doc.in.v": None}, E, EVENTS, "v IS NULL")
where("f_json_in", Events, {"doc.n": {"$in": [3, "4"]}}, E, EVENTS, "n IN (3, 4)")
where("f_json_index", Events, {"doc.l.1": 3}, E, EVENTS, "l1 = 3")
where("f_json_ne", Events, {"doc.in.v": {"$ne": 3}}, E, EVENTS, "v IS DISTINCT FROM 3")
add("s_json_text", Events, {"project": ["event_id"], "sort": ["doc.in.v-", "event_id"], "limit": 40}, f"SELECT event_id FROM {EVENTS} ORDER BY CAST(v AS VARCHAR) DESC NULLS FIRST, event_id LIMIT 40")
# related filters
where("j_related_many", Customer, {"orders.o_totalprice": {"$gt": 300000}, "orders.o_orderstatus": "F"}, C, "customer", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000 AND o_orderstatus = 'F')")
where("j_related_one", Orders, {"customer.c_mktsegment": "BUILDING"}, "o_orderkey", "orders", "EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING')")
where("j_related_or", Customer, {"$or": [{"c_nationkey": 3}, {"orders.o_totalprice": {"$gt": 350000}}]}, C, "customer", "c_nationkey = 3 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
where("j_related_not", Customer, {"$not": {"orders.o_orderstatus": "P"}}, C, "customer", "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")


# nested joins, flattened
def flat(path: str, *columns: str, outer: bool = True):
    """Explodes an array (or opens a struct) in column `path` into its columns."""

    def run(df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)[path]
        if kind.startswith("array"):
            df = df.withColumn(path, (F.explode_outer if outer else F.explode)(path))
        keep = [F.col(c) for c in df.columns if c != path]
        return df.select(*keep, *[F.col(f"{path}.{c}").alias(c) for c in columns])

    return run


def chain(*steps):
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df

    return run


add("j_left_many", Orders, {"project": ["o_orderkey"], "join": {"lineitems": {"project": ["l_linenumber", "l_partkey"]}}}, "SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey", then=flat("lineitems", "l_linenumber", "l_partkey"))
add("j_left_one", Orders, {"project": ["o_orderkey"], "join": ["customer"]}, "SELECT o_orderkey, c_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey", then=flat("customer", "c_custkey", "c_name"))
add("j_left_one_filtered", Orders, {"project": ["o_orderkey"], "join": {"customer": {"project": ["c_name"], "filter": {"c_acctbal": {"$gt": 0}}}}}, "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0", then=flat("customer", "c_name"))
add("j_many_filtered", Customer, {"project": ["c_custkey"], "join": {"orders": {"project": ["o_orderkey"], "filter": {"o_orderstatus": "F"}}}}, "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'", then=flat("orders", "o_orderkey"))
RANKED = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS rn FROM orders)"
add("j_many_topk", Customer, {"project": ["c_custkey"], "join": {"orders": {"project": ["o_orderkey", "o_totalprice"], "sort": ["o_totalprice-"], "limit": 3}}}, f"SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN {RANKED} ON o_custkey = c_custkey AND rn <= 3", then=flat("orders", "o_orderkey", "o_totalprice"))
add("j_many_skip_limit", Customer, {"project": ["c_custkey"], "join": {"orders": {"project": ["o_orderkey"], "sort": ["o_totalprice-"], "skip": 1, "limit": 2}}}, f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {RANKED} ON o_custkey = c_custkey AND rn > 1 AND rn <= 3", then=flat("orders", "o_orderkey"))
add(
    "j_nested3",
    Customer,
    {"project": ["c_custkey", "c_name"], "filter": {"c_mktsegment": {"$ne": "BUILDING"}}, "join": {"orders": {"project": ["o_orderkey"], "filter": {"o_orderstatus": "O"}, "join": {"lineitems": {"project": ["l_linenumber", "l_quantity"], "filter": {"l_quantity": {"$gt": 45}}}}}}},
    "SELECT c_custkey, c_name, o_orderkey, l_linenumber, l_quantity FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'",
    then=chain(flat("orders", "o_orderkey", "lineitems"), flat("lineitems", "l_linenumber", "l_quantity")),
)
add("j_limit_then_join", Customer, {"project": ["c_custkey"], "sort": ["c_acctbal-"], "skip": 2, "limit": 20, "join": {"orders": {"project": ["o_orderkey"]}}}, "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 20 OFFSET 2) LEFT JOIN orders ON o_custkey = c_custkey", then=flat("orders", "o_orderkey"))
add("j_inner_filtered", Orders, {"project": ["o_orderkey"], "joinf": {"lineitems": {"project": ["l_linenumber"], "filter": {"l_returnflag": "R"}}}}, "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'", then=flat("lineitems", "l_linenumber"))
add("j_inner_then_limit", Customer, {"project": ["c_custkey"], "sort": ["c_custkey"], "limit": 50, "joinf": {"orders": {"project": ["o_orderkey"], "filter": {"o_orderstatus": "P"}}}}, "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50) JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'", then=flat("orders", "o_orderkey"))
add("j_inner_bare", Orders, {"project": ["o_orderkey"], "joinf": ["lineitems"]}, "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", then=lambda df: df.select("o_orderkey"))
add("j_inner_nested", Customer, {"project": ["c_custkey"], "joinf": {"orders": {"project": ["o_orderkey"], "joinf": {"lineitems": {"project": ["l_linenumber"], "filter": {"l_quantity": {"$gte": 50}}}}}}}, "SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity >= 50", then=chain(flat("orders", "o_orderkey", "lineitems"), flat("lineitems", "l_linenumber")))
add("j_inner_agg", Customer, {"joinf": {"orders": {"filter": {"o_orderstatus": "F"}}}, "aggregate": {"c_mktsegment": "c_mktsegment", "n": {"$sum": 1}}, "group": ["c_mktsegment"]}, "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1", OPEN)
add("j_inner_count", Orders, {"joinf": {"lineitems": {"filter": {"l_returnflag": "A"}}}, "count": 1}, "SELECT count(*) AS count FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A'")
add("j_m2m", Part, {"project": ["p_partkey"], "filter": {"p_size": {"$lt": 10}}, "join": {"suppliers": {"project": ["s_suppkey", "s_name"]}}}, "SELECT p_partkey, s_suppkey, s_name FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 10", then=flat("suppliers", "s_suppkey", "s_name"))
add("j_two_relations", Nation, {"project": ["n_name"], "join": {"region": {"project": ["r_name"]}, "suppliers": {"project": ["s_name"]}}}, "SELECT n_name, r_name, s_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey", then=chain(flat("region", "r_name"), flat("suppliers", "s_name")))
add("j_by_project", Region, {"project": {"r_name": 1, "nations": {"project": ["n_name"]}}}, "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey", then=flat("nations", "n_name"))
add("j_semi_of_nested", Region, {"project": ["r_name"], "filter": {"nations.n_name": {"$prefix": "A"}}}, "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_name LIKE 'A%')")
add("j_policy_related", Region, {"project": ["r_name"], "join": ["nations"]}, "SELECT r_name, n_name FROM region LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation WHERE n_nationkey > 2) WHERE rn <= 2) ON n_regionkey = r_regionkey", {"related": {"nations": {"max_items": 2, "force_filter": {"n_nationkey": {"$gt": 2}}, "default_projection": ["n_name"]}}}, then=flat("nations", "n_name"))
# aggregates
D = "round(CAST({} AS DOUBLE), 4)"
rounded = lambda *names: lambda df: df.select(*[F.round(F.col(c).cast("double"), 4).alias(c) if c in names else F.col(c) for c in df.columns])
add("a_min_max", Lineitem, {"aggregate": {"lo": {"$min": "l_quantity"}, "hi": {"$max": "l_extendedprice"}}}, "SELECT min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM lineitem", OPEN)
add("a_avg_sum", Lineitem, {"aggregate": {"a": {"$avg": "l_discount"}, "s": {"$sum": "l_linenumber"}}}, f"SELECT {D.format('avg(l_discount)')} AS a, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem", OPEN, then=rounded("a"))
add("a_count_times_n", Orders, {"filter": {"o_orderstatus": "F"}, "aggregate": {"n": {"$sum": 1}, "n10": {"$sum": 10}}}, "SELECT count(*) AS n, count(*) * 10 AS n10 FROM orders WHERE o_orderstatus = 'F'")
add("a_sum_bool", Customer, {"aggregate": {"n": {"$sum": {"nation_or_null": {"$lt": 10}}}, "m": {"$sum": {"c_mktsegment": "BUILDING", "rich": True}}}}, f"SELECT CAST(sum(CAST(nation_or_null < 10 AS INT)) AS BIGINT) AS n, CAST(sum(CAST(c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AS INT)) AS BIGINT) AS m FROM {CUST}")
add("a_sum_related", Customer, {"aggregate": {"n": {"$sum": {"orders.o_orderstatus": "P"}}}}, "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
add("a_group", Lineitem, {"aggregate": {"flag": "l_returnflag", "status": "l_linestatus", "n": {"$sum": 1}, "qty": {"$sum": "l_quantity"}, "disc": {"$avg": "l_discount"}}, "group": ["l_returnflag", "l_linestatus"]}, f"SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, {D.format('sum(l_quantity)')} AS qty, {D.format('avg(l_discount)')} AS disc FROM lineitem GROUP BY 1, 2", OPEN, then=rounded("qty", "disc"))
add("a_group_sort", Customer, {"aggregate": {"band": "c_nationkey", "n": {"$sum": 1}}, "group": ["c_nationkey-"], "sort": ["c_nationkey-"], "skip": 1, "limit": 5}, "SELECT c_nationkey AS band, count(*) AS n FROM customer GROUP BY 1 ORDER BY 1 DESC NULLS FIRST LIMIT 5 OFFSET 1", OPEN)
add("a_group_derived", Customer, {"aggregate": {"n": {"$sum": 1}, "lo": {"$min": "c_custkey"}}, "group": ["balance_band"]}, f"SELECT count(*) AS n, min(c_custkey) AS lo FROM {CUST} GROUP BY balance_band", OPEN)
add("a_json", Events, {"aggregate": {"hi": {"$max": "props.k"}, "avg": {"$avg": "doc.in.v"}}}, f"SELECT max(CAST(props->>'$.k' AS DOUBLE)) AS hi, {D.format('avg(v)')} AS avg FROM {EVENTS}", OPEN, then=rounded("avg"))
add("a_group_json", Events, {"aggregate": {"v": "doc.in.v", "n": {"$sum": 1}}, "group": ["doc.in.v"]}, f"SELECT CAST(v AS VARCHAR) AS v, count(*) AS n FROM {EVENTS} GROUP BY 1", OPEN)
add("a_empty", Orders, {"filter": {"o_orderkey": -1}, "aggregate": {"n": {"$sum": 1}, "s": {"$sum": "o_custkey"}, "b": {"$sum": {"o_custkey": 1}}}}, "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, CAST(sum(CAST(o_custkey = 1 AS INT)) AS BIGINT) AS b FROM orders WHERE o_orderkey = -1", OPEN)
add("a_allowed_columns", Orders, {"aggregate": {"m": {"$max": "o_totalprice"}}}, "SELECT max(o_totalprice) AS m FROM orders", {"aggregate_columns": ["o_totalprice"]})
# sorting, paging, counting, projecting
add("o_sort_nulls", Customer, {"project": ["c_custkey"], "sort": ["nation_or_null-", "c_custkey"], "skip": 5, "limit": 30}, f"SELECT c_custkey FROM {CUST} ORDER BY nation_or_null DESC NULLS FIRST, c_custkey LIMIT 30 OFFSET 5")
add("o_sort_asc", Customer, {"project": ["c_custkey"], "sort": "nation_or_null c_acctbal-", "limit": 30}, f"SELECT c_custkey FROM {CUST} ORDER BY nation_or_null ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey LIMIT 30")
add("l_page", Orders, {"project": ["o_orderkey", "o_totalprice"], "sort": {"o_totalprice": -1}, "skip": 100, "limit": 25}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 100")
add("l_max_items", Customer, {"project": ["c_custkey"], "sort": ["c_custkey"], "limit": 100}, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10", {"max_items": 10})
add("c_count", Orders, {"filter": {"o_totalprice": {"$gt": 200000}}, "count": 1, "limit": 3, "sort": ["o_orderkey"]}, "SELECT count(*) AS count FROM orders WHERE o_totalprice > 200000")
add("p_exclude", Customer, {"project": {"c_acctbal": 0, "c_mktsegment": 0, "nation_or_null": 0, "order_statuses": 0}}, f"SELECT c_custkey, c_name, c_nationkey, balance_band FROM {CUST}")
add("p_derived", Customer, {"project": ["c_custkey", "balance_band", "rich", "name_length"]}, f"SELECT c_custkey, balance_band, c_acctbal > 5000 AS rich, CAST(length(c_name) AS INT) AS name_length FROM {CUST}")
add("p_force", Nation, {"project": {"n_regionkey": 1, "n_name": 1}}, "SELECT n_nationkey, n_name FROM nation", {"force_include": ["n_nationkey"], "force_exclude": ["n_regionkey"]})
add("p_proxy", Customer, {"project": ["c_custkey", "order_statuses"]}, "SELECT c_custkey, o_orderstatus AS order_statuses FROM customer LEFT JOIN orders ON o_custkey = c_custkey", then=lambda df: df.select("c_custkey", F.explode_outer("order_statuses").alias("order_statuses")))
add("p_default", Nation, {}, "SELECT n_name FROM nation", {"default_projection": ["n_name"]})


add("p_bundled", Customer, {"project": ["name_length"]}, "SELECT CAST(length(c_name) AS INT) AS name_length, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", {"bundled_project": {"name_length": ["nation"]}}, then=flat("nation", "n_name"))
add("p_ensured", Nation, {"project": ["n_name"]}, "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", {"ensure_loaded": ["region"]}, then=flat("region", "r_name"))
add("p_exclude_relation", Region, {"project": {"nations": 0}}, "SELECT r_regionkey, r_name FROM region")
add("p_exclude_with_relation", Region, {"project": {"r_name": 0, "nations": 0}}, "SELECT r_regionkey FROM region")
add("p_mixed", Region, {"project": {"r_regionkey": 0, "r_name": 1}}, "SELECT r_name FROM region")
add("p_legacy", Region, {"project": {"r_name": 1, "gone": 1}}, "SELECT r_name FROM region", {"legacy_fields": ["gone"]})
add("p_hidden", Customer, {"project": {"c_name": 0, "c_acctbal": 0, "c_mktsegment": 0, "order_statuses": 0}}, f"SELECT c_custkey, c_nationkey, nation_or_null, balance_band, CAST(length(c_name) AS INT) AS name_length FROM {CUST}", {"default_unexclude_properties": ["name_length"]})
add("f_arr_ne_list", Part, {"project": ["p_partkey"], "filter": {"words": {"$ne": ["hot", "bolt"]}}}, f"SELECT p_partkey FROM {PART} WHERE words <> ['hot', 'bolt']")
add("p_default_exclude", Nation, {}, "SELECT n_nationkey, n_regionkey FROM nation", {"default_exclude": ["n_name"]})
add("j_join_and_joinf", Orders, {"project": ["o_orderkey"], "filter": {"o_orderstatus": "P"}, "join": {"customer": {"project": ["c_name"]}}, "joinf": {"lineitems": {"project": ["l_linenumber"], "filter": {"l_quantity": {"$gt": 40}}}}}, "SELECT o_orderkey, c_name, l_linenumber FROM orders LEFT JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 WHERE o_orderstatus = 'P'", then=chain(flat("customer", "c_name"), flat("lineitems", "l_linenumber")))
add("j_self", Nation, {"project": ["n_name"], "join": {"head": {"project": ["n_name"]}, "members": {"project": ["n_nationkey"], "join": {"head": {"project": ["n_nationkey"]}}}}}, "SELECT n.n_name, h.n_name AS head_name, m.n_nationkey AS member, n2.n_nationkey AS member_head FROM nation n LEFT JOIN nation h ON n.n_regionkey = h.n_nationkey LEFT JOIN nation m ON m.n_regionkey = n.n_nationkey LEFT JOIN nation n2 ON m.n_regionkey = n2.n_nationkey", then=lambda df: df.select("n_name", F.col("head.n_name").alias("head_name"), F.explode_outer("members").alias("m")).select("n_name", "head_name", F.col("m.n_nationkey").alias("member"), F.col("m.head.n_nationkey").alias("member_head")))
add("j_self_semi", Nation, {"project": ["n_name"], "filter": {"members.n_name": {"$prefix": "I"}}}, "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM nation m WHERE m.n_regionkey = n.n_nationkey AND m.n_name LIKE 'I%')")
add("j_same_model_twice", Nation, {"project": ["n_name"], "join": {"region": {"project": ["r_name"]}, "region_of_key": {"project": ["r_name"], "filter": {"r_name": {"$ne": "ASIA"}}}}}, "SELECT n_name, a.r_name AS region, b.r_name AS other FROM nation LEFT JOIN region a ON n_regionkey = a.r_regionkey LEFT JOIN region b ON n_nationkey = b.r_regionkey AND b.r_name <> 'ASIA'", then=lambda df: df.select("n_name", F.col("region.r_name").alias("region"), F.col("region_of_key.r_name").alias("other")))
add("j_on_clause", Customer, {"project": ["c_custkey"], "join": {"urgent_orders": {"project": ["o_orderkey"]}}}, "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'", then=flat("urgent_orders", "o_orderkey"))
add("j_on_clause_semi", Customer, {"project": ["c_custkey"], "filter": {"urgent_orders.o_totalprice": {"$gt": 300000}}}, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")
add("j_legacy", Region, {"project": ["r_name"], "join": {"gone": None, "nations": {"project": ["n_name"]}}}, "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey", {"legacy_fields": ["gone"]}, then=flat("nations", "n_name"))
add("j_m2m_page", Part, {"project": ["p_partkey"], "sort": ["p_retailprice-"], "limit": 15, "join": {"suppliers": {"project": ["s_suppkey"], "sort": ["s_acctbal-"], "limit": 2}}}, "SELECT p_partkey, s_suppkey FROM (SELECT * FROM part ORDER BY p_retailprice DESC NULLS FIRST, p_partkey LIMIT 15) LEFT JOIN (SELECT l_partkey, s_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY s_acctbal DESC NULLS FIRST, s_suppkey) AS rn FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey) ON l_partkey = p_partkey AND rn <= 2", then=flat("suppliers", "s_suppkey"))
add("a_over_project", Nation, {"project": ["n_name"], "aggregate": {"n": {"$sum": 1}}}, "SELECT count(*) AS n FROM nation")
add("o_object", Customer, {"project": ["c_custkey"], "sort": {"c_acctbal": -1}, "limit": 9}, "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 9")
add("o_legacy", Nation, {"project": ["n_name"], "sort": ["gone-", "n_name-"], "limit": 4}, "SELECT n_name FROM nation ORDER BY n_name DESC NULLS FIRST, n_nationkey LIMIT 4", {"legacy_fields": ["gone"]})
add("f_json_whole", Events, {"project": ["event_id"], "filter": {"props": {"$exists": 1}}}, "SELECT event_id FROM events WHERE props IS NOT NULL")
add("g_related_models", Region, {"project": ["r_name"], "join": ["nations"]}, "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 12", {"related_models": {"nation": {"force_filter": {"n_nationkey": {"$gt": 12}}, "default_projection": ["n_name"]}}}, then=flat("nations", "n_name"))
TOP_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC NULLS FIRST, l_linenumber, l_partkey, l_suppkey, l_quantity) AS ln FROM lineitem)"
add(
    "j_limits_everywhere", Customer,
    {"project": ["c_custkey"], "sort": ["c_acctbal-"], "limit": 30, "join": {"orders": {"project": ["o_orderkey"], "sort": ["o_totalprice-"], "limit": 2, "join": {"lineitems": {"project": ["l_extendedprice"], "sort": ["l_extendedprice-"], "limit": 1}}}}},
    f"SELECT c_custkey, o_orderkey, l_extendedprice FROM (SELECT * FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 30) LEFT JOIN {RANKED} ON o_custkey = c_custkey AND rn <= 2 LEFT JOIN {TOP_LINES} ON l_orderkey = o_orderkey AND ln <= 1",
    then=chain(flat("orders", "o_orderkey", "lineitems"), flat("lineitems", "l_extendedprice")),
)
add("j_one_of_many", Lineitem, {"project": ["l_partkey", "l_quantity"], "filter": {"l_quantity": {"$gte": 49}}, "join": {"order": {"project": ["o_orderstatus"], "join": {"customer": {"project": ["c_mktsegment"]}}}, "part": {"project": ["p_brand"]}}}, "SELECT l_partkey, l_quantity, o_orderstatus, c_mktsegment, p_brand FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 49", then=chain(flat("order", "o_orderstatus", "customer"), flat("customer", "c_mktsegment"), flat("part", "p_brand")))
add("a_group_joinf_sum", Orders, {"joinf": {"lineitems": {"filter": {"l_returnflag": "R"}}}, "filter": {"o_totalprice": {"$gt": 1000}}, "aggregate": {"p": "o_orderpriority", "n": {"$sum": 1}, "f": {"$sum": {"o_orderstatus": "F"}}}, "group": ["o_orderpriority"], "sort": ["o_orderpriority-"]}, "SELECT o_orderpriority AS p, count(*) AS n, CAST(sum(CAST(o_orderstatus = 'F' AS INT)) AS BIGINT) AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' WHERE o_totalprice > 1000 GROUP BY 1", OPEN)
add("a_group_of_key", Nation, {"project": ["n_name"], "group": ["n_nationkey"]}, "SELECT n_name FROM nation")


def _no_limit(spark: SparkSession, folder: str) -> DataFrame:
    return Query(Nation, {"max_items": 3}).using(Frames(spark, folder)).options(no_limit_offset=True).query(project=["n_name"], limit=1).end()


def _aliased(spark: SparkSession, folder: str) -> DataFrame:
    return Query(Nation).using(Frames(spark, folder)).aliased("n").query(project=["n_name"], filter={"region.r_name": "ASIA"}).end()


def _end_count(spark: SparkSession, folder: str) -> DataFrame:
    return ask(Customer, spark, folder, {"project": ["c_custkey"], "filter": {"c_acctbal": {"$gt": 0}}, "sort": ["c_custkey"], "skip": 10, "limit": 7}).end_count().with_total("total")


def _from_df(spark: SparkSession, folder: str) -> DataFrame:
    rows = Customer.read(spark, folder).where("c_nationkey = 9")
    return Query(Customer).from_df(rows).query(project=["c_custkey"], filter={"c_acctbal": {"$gt": 0}}).end()


def _by_keys(spark: SparkSession, folder: str) -> DataFrame:
    return by_keys(Orders.read(spark, folder), [(1,), (5,), (9,), (5,)], ("o_orderkey",)).select("o_orderkey", "o_totalprice")


def _json_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = json_lines(ask(Region, spark, folder, {"project": ["r_name"], "join": {"nations": {"project": ["n_name"], "sort": ["n_name"]}}}).end())
    return rows.select(F.get_json_object("value", "$.r_name").alias("r_name"), F.get_json_object("value", "$.nations[0].n_name").alias("first_nation"))


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    return ask(Nation, spark, folder, {"project": ["n_name"], "filter": {"n_nationkey": {"$gt": 3}}}).merge(filter={"n_regionkey": 1}, project=["n_nationkey"]).end()


def _created(spark: SparkSession, folder: str) -> DataFrame:
    return StrictCrudHelper(Nation, const_fields=["n_nationkey"]).create_model({"n_nationkey": 99, "n_name": "ATLANTIS"}, spark)


def _upserted(spark: SparkSession, folder: str) -> DataFrame:
    return CrudHelper(Nation).upsert_many([{"n_nationkey": 1, "n_name": "RENAMED"}, {"n_nationkey": 99, "n_name": "ATLANTIS", "n_regionkey": 0}], Nation.read(spark, folder))


def _merged_joins(spark: SparkSession, folder: str) -> DataFrame:
    q = ask(Region, spark, folder, {"project": ["r_name"], "join": {"nations": {"project": ["n_nationkey"]}}})
    df = q.merge(join={"nations": {"project": ["n_name"], "join": {"suppliers": {"project": ["s_suppkey"]}}}}).end()
    return chain(flat("nations", "n_nationkey", "n_name", "suppliers"), flat("suppliers", "s_suppkey"))(df)


def _merged_sort(spark: SparkSession, folder: str) -> DataFrame:
    return ask(Nation, spark, folder, {"project": ["n_name"], "limit": 6}).merge(sort=["n_regionkey-", "n_name"]).end()


def _by_model(spark: SparkSession, folder: str) -> DataFrame:
    return Nation.query(Frames(spark, folder), {"force_filter": {"n_regionkey": 2}}).query(project=["n_name"]).end()


def _plucked(spark: SparkSession, folder: str) -> DataFrame:
    """Settings that grow by and_more and are taken over, without the row limit, by pluck_from."""
    settings = Settings({"max_items": 3}).and_more(force_filter={"n_regionkey": 1}).pluck_from()
    return ask(Nation, spark, folder, {"project": ["n_name"]}, settings).end()


def _enough(spark: SparkSession, folder: str) -> DataFrame:
    """A handler of a query's own: nulls never pass a comparison that excludes."""

    class Strict(Query):
        handlers = Handlers(column_test=lambda scope, test: column_test(scope, test) & (scope[test.name].isNotNull() if test.operator == "$ne" else F.lit(True)))

    return Strict(Customer).using(Frames(spark, folder)).query(project=["c_custkey"], filter={"nation_or_null": {"$ne": 5}}).end()


def facts(key: str, schema: str, make, sql: str) -> None:
    """Registers what the engine says about a query, as rows."""
    QUERIES[key] = lambda spark, folder: spark.createDataFrame(make(spark, folder), schema)
    ORACLES[key] = sql


def _refused(model: Model, qo: dict, settings: dict | None = None) -> str:
    """The name of the error that a query object is refused with."""
    try:
        Query(model, settings or {}).query(**qo)
    except Exception as e:  # noqa: BLE001
        return type(e).__name__
    return "accepted"


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


REFUSED = [
    ("unknown key", Region, {"prject": 1}, None, "InvalidQueryError"),
    ("unknown column", Region, {"project": ["nope"]}, None, "InvalidColumnError"),
    ("unknown relation", Region, {"join": ["nope"]}, None, "InvalidRelationError"),
    ("disabled part", Region, {"sort": ["r_name"]}, {"sort_enabled": False}, "DisabledError"),
    ("banned relation", Region, {"join": ["nations"]}, {"banned_relations": ["nations"]}, "DisabledError"),
    ("relation not allowed", Nation, {"join": ["region"]}, {"allowed_relations": ["suppliers"]}, "DisabledError"),
    ("unknown setting", Region, {}, {"max_itms": 1}, "KeyError"),
    ("relation of a setting", Region, {}, {"related": {"nope": {}}}, "KeyError"),
    ("direction", Region, {"sort": {"r_name": 2}}, None, "InvalidQueryError"),
    ("two sorted keys", Region, {"sort": {"r_name": 1, "r_regionkey": 1}}, None, "InvalidQueryError"),
    ("insecure aggregate", Orders, {"aggregate": {"m": {"$max": "o_totalprice"}}}, None, "DisabledError"),
    ("ones and zeros", Customer, {"project": {"c_name": 1, "c_acctbal": 0}}, None, "InvalidQueryError"),
    ("raiseload twice", Region, {}, {"raiseload": True, "raiseload_col": True}, "ValueError"),
    ("fine", Region, {"project": ["r_name"]}, {"raiseload": True}, "accepted"),
]
facts("g_refused", "what string, error string", lambda spark, folder: [(what, _refused(m, qo, s)) for what, m, qo, s, _ in REFUSED], _values([(what, e) for what, *_, e in REFUSED], "what, error"))


def _member(q: Query) -> list[tuple]:
    full = q.full_projection()
    return [(n, full[n], int(n in q)) for n in sorted(full)]


facts(
    "p_full_projection", "name string, shown int, loaded int",
    lambda spark, folder: _member(ask(Region, spark, folder, {"project": ["r_name"], "join": ["nations"]})),
    _values([("nations", 1, 1), ("r_name", 1, 1), ("r_regionkey", 0, 1)], "name, shown, loaded"),
)
facts(
    "p_quiet", "name string, shown int, loaded int",
    lambda spark, folder: [x for x in _member(ask(Customer, spark, folder, {"project": ["c_custkey"]}).ensure_loaded("c_name")) if x[0].startswith("c_")],
    _values([("c_acctbal", 0, 0), ("c_custkey", 1, 1), ("c_mktsegment", 0, 0), ("c_name", 0, 1), ("c_nationkey", 0, 0)], "name, shown, loaded"),
)
facts(
    "p_columns_of", "step string, names string",
    lambda spark, folder: [(k, " ".join(sorted(p.visible()))) for k, p in (("include", Projection(Nation).input(["n_name"]).include(["n_regionkey"])), ("exclude", Projection(Nation).input({"n_name": 0}).exclude(["n_regionkey"])))],
    _values([("include", "n_name n_regionkey"), ("exclude", "n_nationkey")], "step, names"),
)
facts(
    "p_tree", "tree string, whole string",
    lambda spark, folder: [(json.dumps(q.projection_tree(), sort_keys=True), json.dumps(q.final_query_object(), sort_keys=True)) for q in [ask(Region, spark, folder, {"project": ["r_name"], "join": {"nations": {"project": ["n_name"], "limit": 3}}}, {"max_items": 7})]],
    _values([('{"nations": {"n_name": 1}, "r_name": 1}', '{"join": {"nations": {"limit": 3, "project": {"n_name": 1, "n_nationkey": 0, "n_regionkey": 0}}}, "limit": 7, "project": {"r_name": 1, "r_regionkey": 0}}')], "tree, whole"),
)
facts(
    "c_kind", "kind string",
    lambda spark, folder: [(ask(Nation, spark, folder, qo).kind,) for qo in ({}, {"count": 1}, {"aggregate": {"n": {"$sum": 1}}})],
    _values([("entities",), ("scalar",), ("tuples",)], "kind"),
)


def _reads(spark: SparkSession, folder: str) -> list[tuple]:
    """Reading a column, a relation and an unknown name of a result row, under each setting."""
    out = []
    for setting in ("none", "raiseload", "raiseload_col", "raiseload_rel"):
        row = ask(Region, spark, folder, {"project": ["r_name"], "limit": 1}, {} if setting == "none" else {setting: True}).rows()[0]
        for name in ("r_regionkey", "nations", "nope"):
            try:
                got = row[name]
            except KeyError as e:
                got = type(e).__name__
            out.append((setting, name, str(got)))
    return out


RAISES = {"none": (), "raiseload": ("r_regionkey", "nations"), "raiseload_col": ("r_regionkey",), "raiseload_rel": ("nations",)}
facts("g_raiseload", "setting string, name string, error string", _reads, _values([(s, n, "NotLoadedError" if n in bad else "KeyError") for s, bad in RAISES.items() for n in ("r_regionkey", "nations", "nope")], "setting, name, error"))

ODD_JSON = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[1, 2]' WHEN 2 THEN '\"x\"' WHEN 3 THEN NULL ELSE 'no json' END"


def _updated(spark: SparkSession, folder: str) -> DataFrame:
    """An object merged into JSON text of every kind."""
    rows = Events.read(spark, folder).withColumn("doc", F.expr(ODD_JSON))
    out = CrudHelper(Events).update_model({"doc": {"b": 2, "c": {"d": "e"}}, "event_type": "new"}, rows)
    return out.select("event_id", "event_type", F.get_json_object("doc", "$.k").alias("k"), F.get_json_object("doc", "$.b").alias("b"), F.get_json_object("doc", "$.c.d").alias("d"))


Pair = Model("nation_by_region", Nation.schema, ("n_regionkey", "n_nationkey"), "nation", registry={})


def _upserted_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Objects with a key of two columns: one that is there, one that is not, and one without a whole key."""
    return CrudHelper(Pair).upsert_many([{"n_regionkey": 1, "n_nationkey": 1, "n_name": "A"}, {"n_regionkey": 0, "n_nationkey": 1, "n_name": "B"}, {"n_nationkey": 1, "n_name": "C"}], Pair.read(spark, folder))


def _view(rows_of: DataFrame) -> CrudView:
    class Regions(CrudView):
        crudhelper = StrictCrudHelper(Region, const_fields=["r_regionkey"])

        def _source(self) -> Frames:
            return Frames(rows_of.sparkSession, frames={"region": rows_of})

        def _query_hook(self, query: Query) -> Query:
            return query.merge(filter={"r_regionkey": {"$lt": 4}})

    return Regions()


def _viewed(spark: SparkSession, folder: str) -> list[tuple]:
    view = _view(Region.read(spark, folder))
    view._get_query_object = lambda: {"project": ["r_name"], "sort": ["r_regionkey-"]}
    out = [("list", ",".join(r["r_name"] for r in view.method_list())), ("get", view.method_get(r_regionkey=2)["r_name"])]
    out.append(("create", json.dumps(view.method_create({"r_regionkey": 9, "r_name": "NEW"}).after)))
    out.append(("update", json.dumps(view.method_update({"r_regionkey": 7, "r_name": "OLD"}, r_regionkey=1).changed)))
    out.append(("delete", view.method_delete(r_regionkey=3).before["r_name"]))
    many = view.method_create_or_update_many([{"r_regionkey": 1, "r_name": "X"}, {"r_name": "Y"}, {"r_regionkey": 77}, 5, {"nope": 1}])
    return [*out, ("many", ",".join(getattr(x, "kind", type(x).__name__) for x in many))]


facts(
    "d_view", "method string, result string", _viewed,
    _values([("list", "EUROPE,ASIA,AMERICA,AFRICA"), ("get", "ASIA"), ("create", '{"r_regionkey": 9, "r_name": "NEW"}'), ("update", '{"r_name": ["AMERICA", "OLD"]}'), ("delete", "EUROPE"), ("many", "update,create,InvalidQueryError,InvalidColumnError")], "method, result"),
)

for key, run, sql in (
    ("j_merge", _merged_joins, "SELECT r_name, n_nationkey, n_name, s_suppkey FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey"),
    ("o_merge", _merged_sort, "SELECT n_name FROM nation ORDER BY n_regionkey DESC NULLS FIRST, n_name LIMIT 6"),
    ("s_of_model", _by_model, "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    ("g_settings", _plucked, "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    ("u_handlers", _enough, f"SELECT c_custkey FROM {CUST} WHERE nation_or_null <> 5"),
    ("d_update", _updated, "SELECT event_id, 'new' AS event_type, CASE event_id % 5 WHEN 0 THEN props->>'$.k' END AS k, '2' AS b, 'e' AS d FROM events"),
    ("d_upsert_pairs", _upserted_pairs, "SELECT CAST(0 AS BIGINT) AS ordinal, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 1 AND n_nationkey = 1) THEN 'update' ELSE 'not_found' END AS change, 1 AS n_nationkey, 'A' AS n_name, 1 AS n_regionkey UNION ALL SELECT 1, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 0 AND n_nationkey = 1) THEN 'update' ELSE 'not_found' END, 1, 'B', 0 UNION ALL SELECT 2, 'create', 1, 'C', NULL"),
    ("c_end_count", _end_count, "SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 7 OFFSET 10"),
    ("l_no_limit_offset", _no_limit, "SELECT n_name FROM nation"),
    ("s_aliased", _aliased, "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name = 'ASIA')"),
    ("s_from_df", _from_df, "SELECT c_custkey FROM customer WHERE c_nationkey = 9 AND c_acctbal > 0"),
    ("s_by_keys", _by_keys, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 9)"),
    ("s_json_rows", _json_rows, "SELECT r_name, min(n_name) AS first_nation FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    ("q_merge", _merged, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 3 AND n_regionkey = 1"),
    ("d_create", _created, "SELECT CAST(99 AS INT) AS n_nationkey, 'ATLANTIS' AS n_name, CAST(NULL AS INT) AS n_regionkey"),
    ("d_upsert_many", _upserted, "SELECT CAST(0 AS BIGINT) AS ordinal, 'update' AS change, n_nationkey, 'RENAMED' AS n_name, n_regionkey FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 1, 'not_found', 99, 'ATLANTIS', 0"),
):
    QUERIES[key] = run
    ORACLES[key] = sql
