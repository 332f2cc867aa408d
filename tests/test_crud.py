"""CRUD helpers and views."""

import json

import pytest

from tessera import InvalidColumnError, InvalidQueryError, pluck
from tessera.crud import ABSENT, CrudHelper, CrudView, MultipleResultsFound, NoResultFound, StrictCrudHelper, saves_relations
from tessera.sources import by_keys, json_lines
from tessera.streaming import on_stream

from .blog import Article, User, frames


@pytest.fixture(scope="module")
def f(spark):
    return frames(spark)


def view(f, qo=None, helper=None):
    class View(CrudView):
        crudhelper = helper or StrictCrudHelper(Article, ro_fields=["uid"], const_fields=["id"], aggregate_insecure=True)
        seen: list = []

        def _source(self):
            return f

        def _get_query_object(self):
            return qo

        @saves_relations("comments")
        def save_comments(self, new, previous, comments=ABSENT):
            self.seen.append(comments)
            return comments

    return View()


def test_helper(f, spark):
    h = CrudHelper(Article, legacy_fields=["old"])
    assert pluck(h.create_model({"id": 1, "data": {"a": 1}, "old": 3}, spark)) == [{"id": 1, "uid": None, "title": None, "theme": None, "data": '{"a": 1}'}]
    with pytest.raises(InvalidColumnError):
        h.create_model({"nope": 1}, spark)
    with pytest.raises(InvalidQueryError):
        h.create_model([1], spark)
    assert json.loads(h.updated({"id": 1, "data": '{"a": 1, "b": 2}'}, {"data": {"b": 3}})["data"]) == {"a": 1, "b": 3}
    rows = pluck(h.update_model({"title": "x", "data": {"rating": 1, "new": "y"}}, f.frames["Article"].where("id in (10, 30)")))
    assert {r["title"] for r in rows} == {"x"}
    assert [json.loads(r["data"]) for r in sorted(rows, key=lambda r: r["id"])] == [{"o": {"a": True}, "rating": 1, "new": "y"}, {"o": {"z": False}, "rating": 1, "new": "y"}]
    assert h.query_model({"filter": {"id": 10}, "count": 1}, f).scalar() == 1


def test_strict(f, spark):
    h = StrictCrudHelper(Article, ro_fields=["uid"], const_fields=["id"], query_defaults={"sort": ["id-"], "project": ["id"]})
    assert pluck(h.create_model({"id": 1, "uid": 5}, spark))[0]["uid"] is None
    assert h.updated({"id": 1, "uid": 5, "title": "a"}, {"id": 2, "uid": 6, "title": "b"}) == {"id": 1, "uid": 5, "title": "b"}
    assert [r["id"] for r in h.query_model({"limit": 2}, f).rows()] == [30, 21]
    assert StrictCrudHelper(Article, rw_fields=["title"]).ro_fields == frozenset(Article.columns) - {"title"}


def test_view(f):
    assert view(f, {"count": 1}).method_list() == 6
    assert view(f, {"project": ["id"], "sort": ["id"], "limit": 1}).method_list() == [{"id": 10}]
    assert view(f, {"aggregate": {"n": {"$sum": 1}}}).method_list() == [{"n": 6}]
    assert view(f, {"project": ["title"]}).method_get(id=10) == {"title": "10"}
    with pytest.raises(NoResultFound):
        view(f).method_get(id=99)
    with pytest.raises(MultipleResultsFound):
        view(f).method_get(uid=1)
    v = view(f)
    made = v.method_create({"id": 50, "uid": 9, "title": "t", "comments": [1]})
    assert (made.kind, made.after["uid"], made.relations, v.seen[-1]) == ("create", None, {"comments": [1]}, [1])
    up = v.method_update({"title": "new"}, id=10)
    assert (up.changed, v.seen[-1]) == ({"title": ("10", "new")}, ABSENT)
    assert v.method_delete(id=10).before["id"] == 10
    assert v.method_create_or_update({"id": 11, "title": "z"}).kind == "update"
    assert v.method_create_or_update({"title": "z"}).kind == "create"
    many = v.method_create_or_update_many([{"id": 10, "title": "m"}, {"title": "n"}, {"id": 77, "title": "o"}, {"id": 12, "nope": 1}])
    assert [getattr(x, "kind", type(x).__name__) for x in many] == ["update", "create", "InvalidColumnError"]


def test_upsert(f):
    got = pluck(CrudHelper(User).upsert_many([{"id": 1, "name": "z"}, {"name": "new"}, {"id": 9}], f.frames["User"]).orderBy("ordinal"))
    assert [(r["change"], r["id"], r["name"], r["age"]) for r in got] == [("update", 1, "z", 18), ("create", None, "new", None), ("not_found", 9, None, None)]


def test_sources(f):
    assert sorted(r["id"] for r in pluck(by_keys(f.frames["User"], [(1,), (3,), (7,)], ("id",)))) == [1, 3]
    assert by_keys(f.frames["User"], [], ("id",)).count() == 0
    assert json.loads(json_lines(f.frames["User"].where("id = 1")).first()[0]) == {"id": 1, "name": "a", "tags": ["1", "a"], "age": 18, "master_id": None}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a", ["x"], 18, None), (2, "b", ["y"], 20, None)], User.schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(User.schema).parquet(str(tmp_path / "in"))
    q = on_stream(User, stream, filter={"age": {"$gt": 18}}, project=["id", "age_in_10"]).writeStream.format("memory").queryName("out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("out").collect()] == [(2, 30)]
    for bad in ({"sort": ["id"]}, {"filter": {"articles.id": 1}}, {"project": ["articles"]}):
        with pytest.raises(InvalidQueryError):
            on_stream(User, stream, **bad)
