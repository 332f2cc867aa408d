"""The projection algebra, without Spark."""

import pytest

from tessera import InvalidQueryError
from tessera.operators.project import EXCLUDE, INCLUDE, MIXED, Projection

from .blog import Article, User

ALL = {"id", "uid", "title", "theme", "data"}


def pr(spec=None, model=Article, **settings):
    return Projection(model, **settings).input(spec)


def shown(p):
    return set(p.visible())


def test_input():
    assert (pr().mode, shown(pr())) == (EXCLUDE, ALL)
    assert "age_in_10" in shown(pr(model=User)) and "user_calculated" not in shown(pr(model=User))
    for nothing in ([], {}):
        assert (pr(nothing).mode, shown(pr(nothing))) == (INCLUDE, set())
    assert shown(pr("id title")) == {"id", "title"}
    assert shown(pr({"id": 0})) == ALL - {"id"}
    with pytest.raises(InvalidQueryError):
        pr({"id": 1, "title": 0})
    everything = dict.fromkeys(Article.attributes, 1) | {"id": 0}
    assert (pr(everything).mode, "id" in shown(pr(everything))) == (MIXED, False)


def test_defaults():
    assert shown(pr(default_exclude=["data"])) == ALL - {"data"}
    assert shown(pr(["data"], default_exclude=["data"])) == {"data"}
    assert shown(pr({"uid": 0, "calculated": 0}, default_exclude_properties=False)) == ALL - {"uid"} | {"hybrid"}
    assert shown(pr({"uid": 0}, default_unexclude_properties=["calculated"])) == ALL - {"uid"} | {"calculated"}
    assert shown(pr(default_projection=["id", "title"])) == {"id", "title"}
    assert shown(pr([], default_projection=["id", "title"])) == set()
    assert shown(pr(default_projection=())) == set()
    p = pr({"uid": 0}, ensure_loaded=["uid"])
    assert "uid" in p and "uid" not in shown(p)


def test_merge():
    assert shown(pr(["id"]).merge(["uid"])) == {"id", "uid"}
    assert shown(pr({"id": 0}).merge({"uid": 0})) == ALL - {"id", "uid"}
    p = pr(["id", "uid"]).merge({"uid": 0})
    assert (p.mode, shown(p)) == (INCLUDE, {"id"})
    p = pr({"id": 0}).merge(["calculated"])
    assert (p.mode, shown(p)) == (MIXED, ALL - {"id"} | {"calculated"})
    assert shown(pr(["id"]).merge(dict.fromkeys(Article.attributes, 0) | {"uid": 1})) == {"uid"}
    p = pr(["id"]).merge(["uid"], quietly=True)
    assert "uid" in p and shown(p) == {"id"} and p.projection == {"id": 1}
    assert shown(p.merge(["uid"])) == {"id", "uid"}


def test_forced():
    p = pr({"data": 0}, force_include=["id"])
    assert (p.mode, "id" in shown(p)) == (MIXED, True)
    assert shown(pr({"id": 1, "data": 1}, force_exclude=["data"])) == {"id"}
    assert shown(pr({"data": 1}, force_exclude=["data"])) == set()
    assert shown(pr(["id"], force_exclude=["data"]).merge(["data"])) == {"id"}
    assert "id" in shown(pr(["uid"], force_include=["id"]).merge({"id": 0}))


def test_bundles():
    p = pr(["calculated"], bundled_project={"calculated": ["title", "uid"]})
    assert "title" in p and shown(p) == {"calculated"}
    p = pr(["calculated", "title"], bundled_project={"calculated": ["title", "uid"]})
    assert shown(p) == {"calculated", "title"}
    assert "user" in pr(["calculated"], bundled_project={"calculated": ["user"]}).joined()
    assert pr(["id", "user"]).joined() == {"user": None}
    assert pr({"id": 1, "user": 0}).joined() == {}
    assert "user" in pr({"id": 1}, force_include=["user"]).joined()
