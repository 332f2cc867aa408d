"""The driver's tables as models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .model import Model, Relationship, Secondary, schema

REGISTRY: dict[str, Model] = {}


def _model(name: str, columns: str, key: str, **more) -> Model:
    return Model(name, schema(columns), tuple(key.split()), registry=REGISTRY, **more)


def _one(target: str, own: str, other: str) -> Relationship:
    return Relationship(target, ((own, other),), many=False)


def _many(target: str, own: str, other: str) -> Relationship:
    return Relationship(target, ((own, other),))


Region = _model("region", "r_regionkey INT, r_name STRING", "r_regionkey", relations={"nations": _many("nation", "r_regionkey", "n_regionkey")})
Nation = _model("nation", "n_nationkey INT, n_name STRING, n_regionkey INT", "n_nationkey", relations={"region": _one("region", "n_regionkey", "r_regionkey"), "region_of_key": _one("region", "n_nationkey", "r_regionkey"), "head": _one("nation", "n_regionkey", "n_nationkey"), "members": _many("nation", "n_nationkey", "n_regionkey"), "customers": _many("customer", "n_nationkey", "c_nationkey"), "suppliers": _many("supplier", "n_nationkey", "s_nationkey")})
Customer = _model(
    "customer",
    "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "c_custkey",
    relations={"nation": _one("nation", "c_nationkey", "n_nationkey"), "orders": _many("orders", "c_custkey", "o_custkey"), "urgent_orders": Relationship("orders", (("c_custkey", "o_custkey"),), where=lambda s: s["o_orderpriority"] == "1-URGENT")},
    column_properties={"nation_or_null": lambda s: F.nullif(s["c_nationkey"], F.lit(3)), "balance_band": lambda s: F.floor(s["c_acctbal"] / 1000).cast("int")},
    hybrids={"rich": lambda s: s["c_acctbal"] > 5000, "has_big_order": lambda s: s.exists("orders", {"o_totalprice": {"$gt": 400000}})},
    properties={"name_length": lambda s: F.length(s["c_name"])},
    proxies={"order_statuses": ("orders", "o_orderstatus")},
)
Supplier = _model("supplier", "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE", "s_suppkey", relations={"nation": _one("nation", "s_nationkey", "n_nationkey")})
Part = _model(
    "part",
    "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE, words ARRAY<STRING>",
    "p_partkey",
    # words: null for every seventh size, empty for every fifth, else the name's words with 'cold' as a null element
    source=lambda spark, folder: spark.read.parquet(f"{folder}/part.parquet").withColumn(
        "words", F.expr("if(p_size % 7 = 0, null, if(p_size % 5 = 0, cast(array() as array<string>), transform(split(p_name, ' '), x -> nullif(x, 'cold'))))")
    ),
    relations={"lineitems": _many("lineitem", "p_partkey", "l_partkey"), "suppliers": Relationship("supplier", secondary=Secondary("lineitem", (("p_partkey", "l_partkey"),), (("l_suppkey", "s_suppkey"),)))},
)
Orders = _model(
    "orders",
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "o_orderkey",
    relations={"customer": _one("customer", "o_custkey", "c_custkey"), "lineitems": _many("lineitem", "o_orderkey", "l_orderkey")},
)
Lineitem = _model(
    "lineitem",
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    # no smaller key: order and line number repeat
    "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_shipdate l_discount l_tax l_returnflag l_linestatus",
    relations={"order": _one("orders", "l_orderkey", "o_orderkey"), "part": _one("part", "l_partkey", "p_partkey"), "supplier": _one("supplier", "l_suppkey", "s_suppkey")},
)
Events = _model(
    "events",
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING, doc STRING",
    "event_id",
    json=frozenset({"props", "doc"}),
    source=lambda spark, folder: spark.read.parquet(f"{folder}/events.parquet").withColumn(
        "doc", F.expr("to_json(named_struct('n', event_id % 50, 'big', event_id % 3 = 0, 'in', named_struct('t', event_type, 'v', if(event_id % 4 = 0, null, event_id % 9)), 'l', array(event_id % 5, event_id % 7)))")
    ),
)
