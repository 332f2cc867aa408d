"""A small blog: models and rows on which expected answers are known."""

from pyspark.sql import functions as F

from tessera import Frames, Model, Relationship, Secondary
from tessera import schema as ddl

REG: dict = {}

User = Model(
    "User", ddl("id INT, name STRING, tags ARRAY<STRING>, age INT, master_id INT"), ("id",),
    column_properties={"age_in_10": lambda s: s["age"] + 10},
    properties={"user_calculated": lambda s: s["age"] + 10},
    relations={"articles": Relationship("Article", (("id", "uid"),)), "comments": Relationship("Comment", (("id", "uid"),)), "master": Relationship("User", (("master_id", "id"),), many=False)},
    registry=REG,
)
Article = Model(
    "Article", ddl("id INT, uid INT, title STRING, theme STRING, data STRING"), ("id",), json=frozenset({"data"}),
    properties={"calculated": lambda s: F.length(s["title"]) + s["uid"]},
    hybrids={"hybrid": lambda s: (s["id"] > 10) & s.exists("user", {"age": {"$gt": 18}})},
    relations={"user": Relationship("User", (("uid", "id"),), many=False), "comments": Relationship("Comment", (("id", "aid"),))},
    registry=REG,
)
Comment = Model(
    "Comment", ddl("id INT, aid INT, uid INT, text STRING"), ("id",),
    properties={"comment_calc": lambda s: F.right(s["text"], F.lit(3))},
    relations={"user": Relationship("User", (("uid", "id"),), many=False), "article": Relationship("Article", (("aid", "id"),), many=False)},
    registry=REG,
)
Watcher = Model(
    "Watcher", ddl("id INT, name STRING, age INT, favorite_id INT"), ("id",),
    proxies={"best_names": ("best", "name"), "good_names": ("good", "name")},
    relations={
        "favorite": Relationship("User", (("favorite_id", "id"),), many=False),
        "best": Relationship("User", secondary=Secondary("favorites", (("id", "gw_id"),), (("user_id", "id"),), lambda t: t["best"])),
        "good": Relationship("User", secondary=Secondary("favorites", (("id", "gw_id"),), (("user_id", "id"),), lambda t: ~t["best"])),
    },
    registry=REG,
)

ROWS = {
    "User": [(1, "a", ["1", "a"], 18, None), (2, "b", ["2", "a", "b"], 18, None), (3, "c", ["3", "a", "b", "c"], 16, None)],
    "Article": [
        (10, 1, "10", None, '{"rating":5,"o":{"a":true}}'), (11, 1, "11", None, '{"rating":5.5,"o":{"a":true}}'), (12, 1, "12", None, '{"rating":6,"o":{"a":false}}'),
        (20, 2, "20", None, '{"rating":4.5,"o":{"a":false}}'), (21, 2, "21", None, '{"rating":4,"o":{"z":true}}'), (30, 3, "30", None, '{"o":{"z":false}}'),
    ],
    "Comment": [(100, 10, 1, "10-a"), (101, 10, 2, "10-b"), (102, 10, 3, "10-c"), (103, 11, 1, "11-a"), (104, 11, 2, "11-b"), (105, 12, 1, "12-a"), (106, 20, 1, "20-a-ONE"), (107, 20, 1, "20-a-TWO"), (108, 21, 1, "21-a")],
    "Watcher": [(1, "Fred", 65, 3), (2, "Ban", 55, 2)],
}


def frames(spark) -> Frames:
    out = {name: spark.createDataFrame(rows, REG[name].schema) for name, rows in ROWS.items()}
    out["favorites"] = spark.createDataFrame([(1, 2, False), (1, 3, True), (2, 1, False), (2, 2, True), (2, 3, False)], "gw_id INT, user_id INT, best BOOLEAN")
    return Frames(spark, "", out)
