"""The plans are the ones wanted: filters and columns reach the scans, no Cartesian product, one shuffle a child."""

import os
import re

import pytest

from tessera import Frames, Query
from tessera.crud import CrudHelper
from tessera.models_tpch import Customer, Orders, Part

FOLDER = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


def plan(spark, model, settings=None, **qo):
    df = Query(model, settings or {}).using(Frames(spark, FOLDER)).query(**qo).end()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_pushdown(spark):
    p = plan(spark, Customer, project=["c_custkey"], filter={"c_mktsegment": {"$ne": "BUILDING"}, "c_acctbal": {"$gte": 10}, "c_name": {"$prefix": "Cust"}})
    assert "Not(EqualNullSafe(c_mktsegment,BUILDING))" in p and "GreaterThanOrEqual(c_acctbal,10.0)" in p and "StringStartsWith(c_name,Cust)" in p
    assert "c_nationkey" not in re.search(r"ReadSchema: (.*)", p)[1]


def test_nested(spark):
    p = plan(spark, Customer, project=["c_custkey"], join={"orders": {"project": ["o_orderkey"], "filter": {"o_orderstatus": "F"}}})
    assert "Cartesian" not in p and "NestedLoop" not in p and "EqualTo(o_orderstatus,F)" in p
    assert all("o_orderdate" not in s for s in re.findall(r"ReadSchema: (.*)", p))


def test_top_k_of_each_parent(spark):
    p = plan(spark, Customer, project=["c_custkey"], join={"orders": {"project": ["o_orderkey"], "sort": ["o_totalprice-"], "limit": 2}})
    assert "WindowGroupLimit" in p
    assert len(set(re.findall(r"hashpartitioning\(__k0", p))) == 1


def test_page_before_join(spark):
    p = plan(spark, Customer, project=["c_custkey"], sort=["c_acctbal-"], limit=5, join={"orders": {"project": ["o_orderkey"]}})
    assert "TakeOrderedAndProject" in p and "LeftSemi" in p


def test_count_prunes(spark):
    p = plan(spark, Orders, count=1, filter={"o_orderstatus": "F"}, sort=["o_totalprice"], join=["lineitems"])
    assert re.findall(r"ReadSchema: (.*)", p) == ["struct<o_orderstatus:string>"] and "lineitem" not in p


def test_related_filters_share_a_semi_join(spark):
    p = plan(spark, Customer, project=["c_custkey"], filter={"orders.o_orderstatus": "F", "orders.o_totalprice": {"$gt": 1}})
    assert len(re.findall(r"Join type: LeftSemi", p)) == 1


def above(tree, table):
    """The operators over the scan that reads a column of this name, from the scan upwards."""
    lines = [(len(re.match(r"[ :|+\-*()0-9]*", x)[0]), x) for x in tree.splitlines()]
    out = []
    for k in (i for i, (_, x) in enumerate(lines) if "FileScan" in x and table in x):
        depth, chain = lines[k][0], []
        for d, x in reversed(lines[:k]):
            if d < depth:
                depth = d
                chain.append(x)
        out.append(chain)
    return out


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_restrict_every_level(spark):
    qo = {"project": ["c_custkey"], "sort": ["c_acctbal-"], "limit": 5, "join": {"orders": {"project": ["o_orderkey"], "sort": ["o_totalprice-"], "limit": 2, "join": {"lineitems": {"project": ["l_extendedprice"], "sort": ["l_extendedprice-"], "limit": 1}}}}}
    df = Query(Customer).using(Frames(spark, FOLDER)).query(**qo).end()
    tree = df._jdf.queryExecution().sparkPlan().toString()
    for column in ("o_custkey", "l_orderkey"):
        chains = above(tree, f"[{column}") + above(tree, f", {column}") + above(tree, f",{column}")
        assert chains
        for chain in chains:
            first = next(x for x in chain if "Join" in x or "Window " in x or "Aggregate" in x)
            assert "LeftSemi" in first
    final = executed(df).split("== Initial Plan ==")[0]
    assert len(re.findall("TakeOrderedAndProject", final)) == 1 and "Reused" in final


def test_pairs_of_wanted_parents_only(spark):
    p = plan(spark, Part, project=["p_partkey"], filter={"p_size": {"$lt": 10}}, join={"suppliers": {"project": ["s_suppkey"]}})
    assert len(re.findall("LeftSemi", p)) >= 1


def test_upsert_reads_its_keys_only(spark):
    p = CrudHelper(Orders).upsert_many([{"o_orderkey": 1, "o_orderstatus": "X"}], Orders.read(spark, FOLDER))._jdf.queryExecution().sparkPlan().toString()
    chain = above(p, "o_orderkey")
    assert chain and all("LeftSemi" in next(x for x in c if "Join" in x) for c in chain)
