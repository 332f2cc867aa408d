"""Answers of whole queries on the blog."""

import pytest

from tessera import DisabledError, InvalidColumnError, InvalidQueryError, InvalidRelationError, Query

from .blog import Article, Comment, User, Watcher, frames


@pytest.fixture(scope="module")
def f(spark):
    return frames(spark)


def ask(f, model, settings=None, **qo):
    return Query(model, settings or {}).using(f).query(**qo)


def ids(f, model, settings=None, **qo):
    return [r["id"] for r in ask(f, model, settings, project=["id"], **qo).rows()]


OPEN = {"aggregate_insecure": True}


def test_sort(f):
    assert ids(f, User, sort=["age+", "id+"]) == [3, 1, 2]
    assert ids(f, Article, sort=["data.rating-"]) == [30, 12, 11, 10, 20, 21]
    assert ids(f, User, sort="id-", limit=1, skip=1) == [2]


def test_filters(f):
    assert ids(f, User, filter={"age": 16}) == [3]
    for criteria, want in [
        ({"age": {"$ne": 16}}, [1, 2]), ({"age": {"$lt": 18}}, [3]), ({"age": {"$gte": 18}, "id": 2}, [2]), ({"name": {"$prefix": "a"}}, [1]), ({"id": {"$in": [1, 3]}}, [1, 3]),
        ({"id": {"$nin": [1, 3]}}, [2]), ({"master_id": {"$exists": False}}, [1, 2, 3]), ({"master_id": None}, [1, 2, 3]), ({"master_id": {"$ne": 1}}, [1, 2, 3]), ({"master_id": {"$nin": [1]}}, []),
        ({"tags": "1"}, [1]), ({"tags": ["1", "a"]}, [1]), ({"tags": {"$ne": "1"}}, [2, 3]), ({"tags": {"$in": ["1", "3"]}}, [1, 3]), ({"tags": {"$nin": ["1", "3"]}}, [2]),
        ({"tags": {"$all": ["a", "b"]}}, [2, 3]), ({"tags": {"$size": 2}}, [1]), ({"tags": {"$size": 0}}, []), ({"tags": {"$exists": 1}}, [1, 2, 3]),
        ({"$or": [{"id": 1}, {"age": 16}]}, [1, 3]), ({"$nor": [{"id": 1}, {"age": 16}]}, [2]), ({"$not": {"id": 1}}, [2, 3]), ({"$not": {}}, []), ({"$and": [{"id": 1}, {"age": 18}]}, [1]), ({}, [1, 2, 3]),
        ({"age_in_10": 26}, [3]), ({"id": {"$in": []}}, []), ({"articles.id": 30}, [3]), ({"$or": [{"articles.id": 30}, {"id": 1}]}, [1, 3]), ({"$not": {"articles.title": {"$prefix": "1"}}}, [2, 3]),
        ({"comments.aid": 20, "comments.text": "10-a"}, []),
    ]:
        assert sorted(ids(f, User, filter=criteria)) == want, criteria


def test_json(f):
    for criteria, want in [({"data.rating": {"$gte": 5.5}}, [11, 12]), ({"data.o.a": True}, [10, 11]), ({"data.o.a": None}, [21, 30]), ({"data.rating": "5.5"}, [11]), ({"data.rating": {"$in": [5, "6"]}}, [10, 12]), ({"hybrid": True}, []), ({"user.age": 16}, [30])]:
        assert sorted(ids(f, Article, filter=criteria)) == want, criteria


def test_aggregates(f):
    assert ask(f, User, OPEN, aggregate={"max_age": {"$max": "age"}, "adults": {"$sum": {"age": {"$gte": 18}}}}).rows() == [{"max_age": 18, "adults": 2}]
    assert ask(f, User, aggregate={"n": {"$sum": 1}}).rows() == [{"n": 3}]
    assert ask(f, User, filter={"id": 1}, aggregate={"n": {"$sum": 10}}).rows() == [{"n": 10}]
    assert ask(f, User, OPEN, aggregate={"age": "age", "n": {"$sum": 1}}, group=["age"], sort=["age-"]).rows() == [{"age": 18, "n": 2}, {"age": 16, "n": 1}]
    assert ask(f, Article, OPEN, aggregate={"high": {"$sum": {"data.rating": {"$gte": 5.0}}}, "max_rating": {"$max": "data.rating"}, "a_is_none": {"$sum": {"data.o.a": None}}}).rows() == [{"high": 3, "max_rating": 6.0, "a_is_none": 2}]
    assert ask(f, Article, OPEN, aggregate={"n": {"$sum": 1}, "s": {"$sum": "id"}, "m": {"$max": "data.rating"}, "a": {"$avg": "data.rating"}}).rows() == [{"n": 6, "s": 104, "m": 6.0, "a": 5.0}]
    assert ask(f, User, count=True).scalar() == 3
    assert ask(f, User, count=1, joinf={"articles": {"filter": {"id": {"$lt": 20}}}}).scalar() == 3
    assert ask(f, User, {"aggregate_columns": ["age"]}, aggregate={"n": {"$sum": 1}}, joinf={"comments": {"filter": {"aid": 20}}}).rows() == [{"n": 2}]


def test_join(f):
    assert ask(f, User, project=["id"], filter={"id": 1}, join={"articles": {"project": ["id", "title"], "filter": {"id": 10}, "limit": 1}}).rows() == [{"id": 1, "articles": [{"id": 10, "title": "10"}]}]
    got = ask(f, User, project=["id"], joinf={"articles": {"project": ["id"], "joinf": {"comments": {"project": ["id"], "filter": {"text": "20-a-ONE"}}}}}).rows()
    assert got == [{"id": 2, "articles": [{"id": 20, "comments": [{"id": 106}]}]}]
    got = ask(f, User, project=["id"], join={"articles": {"project": ["id", "uid"], "sort": ["id-"], "limit": 1}}, sort=["id-"], limit=2).rows()
    assert got == [{"id": 3, "articles": [{"id": 30, "uid": 3}]}, {"id": 2, "articles": [{"id": 21, "uid": 2}]}]
    got = ask(f, User, project=["id"], join={"articles": {"project": ["id"], "sort": ["id-"], "skip": 1, "limit": 1}}, sort=["id-"], skip=1, limit=2).rows()
    assert got == [{"id": 2, "articles": [{"id": 20}]}, {"id": 1, "articles": [{"id": 11}]}]
    got = ask(f, User, project=["id"], sort=["id-"], limit=2, join={"articles": {"project": ["id"], "sort": ["id-"], "limit": 1, "join": {"comments": {"project": ["id"], "sort": ["id-"], "limit": 1}}}}).rows()
    assert got == [{"id": 3, "articles": [{"id": 30, "comments": []}]}, {"id": 2, "articles": [{"id": 21, "comments": [{"id": 108}]}]}]
    assert ask(f, Article, project=["id"], filter={"id": 30}, join={"user": {"project": ["name"], "filter": {"id": 1}}}).rows() == [{"id": 30, "user": None}]
    assert ask(f, Article, project=["id"], filter={"id": 30}, join=["user", "comments"]).rows()[0]["user"]["name"] == "c"
    assert ask(f, User, project=["id"], filter={"id": 1}, join=["master"]).rows() == [{"id": 1, "master": None}]
    assert ask(f, User, project={"id": 1, "articles": {"project": ["id"], "filter": {"id": 21}}}, filter={"id": 2}).rows() == [{"id": 2, "articles": [{"id": 21}]}]
    assert sorted(ids(f, Article, joinf=["comments"])) == [10, 11, 12, 20, 21]
    assert len(ask(f, Article, {"bare_joinf_filters": False}, project=["id"], joinf=["comments"]).rows()) == 6


def test_many_to_many(f):
    got = ask(f, Watcher, project=["id"], sort=["id"], join={"best": {"project": ["id"]}, "good": {"project": ["id"], "sort": ["id-"], "limit": 1}}).rows()
    assert got == [{"id": 1, "best": [{"id": 3}], "good": [{"id": 2}]}, {"id": 2, "best": [{"id": 2}], "good": [{"id": 3}]}]
    assert ask(f, Watcher, project=["id", "good_names"], sort=["id"]).rows() == [{"id": 1, "good_names": ["b"]}, {"id": 2, "good_names": ["a", "c"]}]
    assert ids(f, Watcher, filter={"good_names": {"$in": ["b"]}}) == [1]
    assert ids(f, Watcher, filter={"best.age": 18}) == [2]


def test_end_count(f):
    c = ask(f, Article, skip=1, limit=3, sort=["id"]).end_count()
    assert (c.count, len(list(c))) == (6, 3)
    c = ask(f, Article, skip=9, limit=3).end_count()
    assert (len(list(c)), c.count) == (0, 6)


def test_projection_out(f):
    row = ask(f, Article, filter={"id": 10}).rows()[0]
    assert set(row) == {"id", "uid", "title", "theme", "data"}
    assert ask(f, Article, project=["calculated", "hybrid"], filter={"id": 11}).rows() == [{"calculated": 3, "hybrid": False}]
    assert ask(f, Comment, project={"aid": 0, "uid": 0, "text": 0}, filter={"id": 100}).rows() == [{"id": 100}]
    assert ask(f, User, project=[], filter={"id": 1}).rows() == [{}]


@pytest.mark.parametrize(
    "model, settings, qo, error",
    [
        (User, {}, {"filter": []}, InvalidQueryError), (User, {}, {"filter": {"nope": 1}}, InvalidColumnError), (User, {}, {"filter": {"$or": []}}, InvalidQueryError), (User, {}, {"filter": {"$not": [1]}}, InvalidQueryError),
        (User, {}, {"filter": {"id": {"$in": 1}}}, InvalidQueryError), (User, {}, {"filter": {"tags": {"$gt": 1}}}, InvalidQueryError), (User, {}, {"filter": {"id": {"$size": 1}}}, InvalidQueryError), (User, {}, {"filter": {"user_calculated": 1}}, InvalidColumnError),
        (User, {}, {"sort": {"id": 1, "age": 1}}, InvalidQueryError), (User, {}, {"sort": {"id": 2}}, InvalidQueryError), (User, {}, {"sort": ["articles"]}, InvalidColumnError), (User, {}, {"limit": "1"}, InvalidQueryError), (User, {}, {"count": "x"}, InvalidQueryError),
        (User, {}, {"aggregate": {"a": {"$max": "age"}}}, DisabledError), (User, OPEN, {"aggregate": {"a": {"$max": {"age": 1}}}}, InvalidQueryError), (User, OPEN, {"aggregate": {"a": {"$max": "age", "$min": "age"}}}, InvalidQueryError), (User, OPEN, {"aggregate": {"a": {"$x": "age"}}}, InvalidQueryError),
        (User, OPEN, {"aggregate": {"n": {"$sum": 1}}, "sort": ["age"]}, InvalidQueryError), (User, {}, {"group": ["age"]}, InvalidQueryError), (User, {}, {"join": ["nope"]}, InvalidRelationError), (User, {}, {"join": {"master": {"limit": 1}}}, InvalidQueryError),
        (User, {}, {"join": {"articles": {"count": 1}}}, InvalidQueryError), (User, {}, {"joinf": {"articles": {"limit": 1}}}, InvalidQueryError), (User, {}, {"project": {"id": 1, "name": 0}}, InvalidQueryError), (User, {}, {"what": 1}, InvalidQueryError),
        (User, {"join_enabled": False}, {"joinf": ["articles"]}, DisabledError), (User, {"filter_enabled": False}, {"filter": {}}, DisabledError), (User, {"banned_relations": ["articles"]}, {"join": ["articles"]}, DisabledError), (User, {"allowed_relations": ["comments"]}, {"join": ["articles"]}, DisabledError),
        (User, {"related": {"articles": {"max_items": 2}}}, {"joinf": {"articles": {"filter": {"id": 1}}}}, ValueError), (Article, {}, {"project": ["data.rating"]}, InvalidColumnError),
    ],
)
def test_errors(model, settings, qo, error):
    with pytest.raises(error):
        Query(model, settings).query(**qo)


def test_settings(f):
    assert ids(f, User, {"max_items": 2}, sort=["id"]) == [1, 2]
    assert ids(f, User, {"max_items": 2}, sort=["id"], limit=1) == [1]
    assert ask(f, User, {"max_items": 2}, count=1).scalar() == 3
    assert ids(f, User, {"force_filter": {"age": 18}}, sort=["id"]) == [1, 2]
    assert ids(f, User, {"force_filter": lambda s: [s["age"] == 16]}) == [3]
    assert ids(f, User, {"scalar_operators": {"$search": lambda c, lit, v: c.ilike(f"%{v}%")}}, filter={"name": {"$search": "B"}}) == [2]
    got = ask(f, User, {"related": {"articles": {"force_filter": {"id": 10}, "default_projection": ["id"]}}}, project=["id"], filter={"id": 1}, join=["articles"]).rows()
    assert got == [{"id": 1, "articles": [{"id": 10}]}]
    got = ask(f, User, {"related_models": {"*": lambda m: {"default_projection": ["id"], "max_items": 1} if m is Article else None}}, project=["id"], filter={"id": 1}, join=["articles"]).rows()
    assert got == [{"id": 1, "articles": [{"id": 10}]}]
    assert ids(f, User, {"legacy_fields": ["old"]}, filter={"old": 1, "id": 1}, sort=["old"], join=["old"]) == [1]
    with pytest.raises(KeyError):
        Query(User, {"nope": 1})
    with pytest.raises(KeyError):
        Query(User, {"related": {"nope": {}}})
    q = Query(User, {"max_items": 1}).using(f).options(no_limit_offset=True).query(limit=1)
    assert len(q.rows()) == 3


def test_merge(f):
    q = ask(f, User, filter={"age": 18}, project=["id"]).merge(filter={"id": 2}, project=["name"])
    assert q.rows() == [{"id": 2, "name": "b"}]
    q = ask(f, User, project=["id"], filter={"id": 1}).ensure_loaded("age", "articles")
    assert "age" in q and "articles" in q
    assert q.rows() == [{"id": 1}]
    q = ask(f, User, project=["id"], join={"articles": {"project": ["id"]}}).merge(join={"articles": {"project": ["title"]}})
    assert set(q.rows()[0]["articles"][0]) == {"id", "title"}
    assert q.projection_tree() == {"id": 1, "articles": {"id": 1, "title": 1}}


def test_from_df(f):
    df = f.frames["User"].where("id > 1")
    assert Query(User).from_df(df).query(count=1).scalar() == 2
    assert User.query(df).query(filter={"id": 1}).rows() == []


def test_no_cartesian_product(f):
    plan = ask(f, User, filter={"articles.id": 30, "$or": [{"comments.id": 1}, {"id": 3}]}).end()._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "LeftSemi" in plan and "ExistenceJoin" in plan


def test_inherited_model(spark, tmp_path):
    from tessera import Model, schema

    cars = Model("Car", schema("id INT, maker STRING"), ("id",), "car", hybrids={"ours": lambda s: s["maker"] == "us"}, registry={})
    electric = cars.extended("ElectricCar", schema("id INT, battery INT"), "electric", hybrids={"big": lambda s: s["battery"] > 50})
    spark.createDataFrame([(1, "us"), (2, "them"), (3, "us")], cars.schema).write.parquet(str(tmp_path / "car.parquet"))
    spark.createDataFrame([(2, 40), (3, 60)], schema("id INT, battery INT")).write.parquet(str(tmp_path / "electric.parquet"))
    q = lambda m, **qo: Query(m).with_session(spark, str(tmp_path)).query(**qo)
    assert q(cars, count=1).scalar() == 3
    assert q(electric, sort=["id"]).rows() == [{"id": 2, "maker": "them", "battery": 40}, {"id": 3, "maker": "us", "battery": 60}]
    assert q(electric, filter={"ours": True, "big": True}, project=["id"]).rows() == [{"id": 3}]


def test_configured_model(f):
    Watcher.configure(default_projection=["name"], max_items=1)
    try:
        assert Watcher.query(f).query(sort=["id"]).rows() == [{"name": "Fred"}]
    finally:
        Watcher.configure()
    assert len(Watcher.query(f).rows()) == 2


def test_metadata(f):
    q = ask(f, User, OPEN, project=["id"], join={"articles": {"project": ["id"], "filter": {"id": 10}}})
    assert q.projection == {"id": 1, "articles": 1}
    assert q.full_projection()["articles"] == 1 and q.full_projection()["name"] == 0 and q.full_projection()["comments"] == 0
    assert q.projection_tree() == {"id": 1, "articles": {"id": 1}}
    assert q.projection_tree(full=True)["articles"]["title"] == 0
    final = q.final_query_object()
    assert final["project"]["id"] == 1 and final["join"]["articles"]["filter"] == {"id": 10}
    assert "articles" in q and "comments" not in q
    assert ask(f, User, OPEN, aggregate={"n": {"$sum": 1}}).projection == {"n": 1}
    assert (ask(f, User, count=0, limit=1).kind, ask(f, User, count=1).kind) == ("entities", "scalar")
