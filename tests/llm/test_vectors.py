"""Nearest neighbours and near-duplicate embeddings against brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, g int"
ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [1.0, float("nan")] + [0.0] * 6), (9005, [float("inf")] + [0.0] * 7), (9006, [None] + [1.0] * 7), (9007, [1.0, 2.0]), (None, [1.0] * 8)]


def rows(n=300, d=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[100:160] = x[7] + rng.standard_normal((60, d)).astype(np.float32) * 0.05  # a group of near copies
    x[200:240] = x[5]  # exact copies
    x[250:255] = x[5] * 2  # the same direction, longer
    return x


def frame(spark, x, odd=True):
    data = [(i, [float(c) for c in v], 0, "s", 1) for i, v in enumerate(x)] + [(i, v, None, None, None) for i, v in (ODD if odd else [])]
    return spark.createDataFrame([*data, data[3], data[3]], SCHEMA)


def test_search(spark):
    x = rows()
    df = frame(spark, x)
    got = ann.search(df, df.where("vec_id % 20 = 0 or vec_id > 9000"), 20).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert set(by) == {i for i in range(len(x)) if i % 20 == 0}
    hit = 0
    for q, found in by.items():
        s = x.astype(float) @ x[q].astype(float)
        order = [i for i in sorted(range(len(x)), key=lambda i: (-s[i], i)) if i != q][:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(math.isclose(v, s[i], rel_tol=1e-12, abs_tol=1e-12) for _, i, v in found)
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
        hit += len({i for _, i, _ in found} & set(order))
    assert hit >= 0.9 * 20 * len(by)


def brute(x, q, k):
    """Ids by largest inner product, ties to the smaller one."""
    s = x.astype(float) @ x[q].astype(float)
    return [i for i in sorted(range(len(x)), key=lambda i: (-s[i], i)) if i != q][:k]


@pytest.mark.parametrize("stretch", [300, 10_000])
def test_search_beside_a_very_long_vector(spark, stretch):
    x = np.random.default_rng(4).standard_normal((1500, 16)).astype(np.float32)
    x[77] *= stretch
    x[78] /= stretch
    df = frame(spark, x, odd=False)
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0"), 20, sample=400).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    assert set(got) == set(range(0, 1500, 50)) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    assert sum(len(set(got[q].values()) & set(brute(x, q, 20))) for q in got) >= 0.95 * 20 * len(got)


def test_search_with_ties(spark):
    """Different vectors of equal inner product with the query: the smallest ids are due, exactly."""
    x = np.zeros((120, 8), dtype=np.float32)
    x[:, 0] = 1
    for i in range(1, 120):
        x[i, 1 + i % 7] = 1 + i // 7  # orthogonal to the query but for the first component
    df = frame(spark, x, odd=False)
    got = ann.search(df, df.where("vec_id = 0"), 20, block=16).orderBy("rank").collect()
    assert [r["id"] for r in got] == list(range(1, 21)) and {r["score"] for r in got} == {1.0}


def test_search_of_several_lengths(spark):
    df = frame(spark, rows())
    more = spark.createDataFrame([(5000 + i, [1.0, float(i)], 0, "s", 1) for i in range(5)], SCHEMA)
    got = ann.search(df.union(more), more, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got if r["query_id"] == 5004) == [(5004, 1, 5003), (5004, 2, 5002), (5004, 3, 9007)]


def test_search_of_little(spark):
    df = frame(spark, rows()[:3], odd=True)
    got = ann.search(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()
    assert sorted(r["id"] for r in got) == [1, 2]
    assert ann.search(df.limit(0), df, 20).count() == 0
    huge = spark.createDataFrame([(1, [1e200, 1.0]), (2, [1e-200, 0.0]), (3, [1.0, 2.0]), (4, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in ann.search(huge, huge, 20).orderBy("query_id").collect()] == [(3, 4), (4, 3)]
    assert ann.search(df, df.where("vec_id = 9001"), 20).count() == 0


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(0)
    q, x = rng.standard_normal((20, 65)).astype("f4"), rng.standard_normal((900, 65)).astype("f4")
    full = ((q[:, None] - x[None]) ** 2).sum(-1)
    qi, ri, far = ann.scan(q, x, 10, np.full(20, np.inf))
    assert np.allclose(far, full[qi, ri], rtol=1e-4)
    best = [set(np.argsort(f)[:10]) for f in full]
    assert sum(len(best[k] & set(ri[qi == k])) for k in range(20)) >= 0.95 * 200
    assert len(qi) < 0.5 * full.size


def test_links(spark):
    x = rows()
    got = {r["id"]: r for r in near_vectors.link(frame(spark, x)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    n = near.sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    assert got[230]["component_id"] == got[5]["component_id"] == got[252]["component_id"] and found[230] >= 44
    assert len({got[i]["component_id"] for i in range(100, 160)}) == 1
    for i, _ in ODD:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(got) == len(x) + len(ODD)


def test_near_embeddings_that_link(spark, tmp_path):
    """The query and its SQL on vectors of the driver's kind with near copies among them, exact ones, long ones and odd ones."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    x[250:330] = x[rng.integers(0, 60, 80)] + 0.25 * rng.standard_normal((80, 64)).astype(np.float32)
    x[330:360] = x[3]
    x[360:380] = x[rng.integers(0, 60, 20)] * np.float32(2.5)
    data = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(i, v, None) for i, v in ODD if i]
    data += [(9100 + i, [1.0, float(i)], 0) for i in range(4)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = near_vectors.op8_near_embeddings(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(near_vectors.OP8_SQL)
    rows = {r["vec_id"]: tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()}
    due = {r[0]: r for r in want.project("vec_id, n_links, component_id, kept").fetchall()}
    assert sum(r[1] for r in due.values()) > 1000 and set(rows) == set(due)
    assert all(rows[i][1] <= due[i][1] for i in due)
    assert sum(r[1] for r in rows.values()) >= 0.98 * sum(r[1] for r in due.values())
    assert sum(rows[i] == due[i] for i in due) >= 0.97 * len(due)


def test_dense_groups(spark, monkeypatch):
    """Tight groups, near each other and not, with vectors at their borders: each link is counted once, none within a group is a row."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((4, 32))
    centre[1] = centre[0] + 0.42 * rng.standard_normal(32)  # a group at the border of another
    centre[2] = centre[0] + 0.05 * rng.standard_normal(32)  # one well inside its reach
    x = np.concatenate([c + 0.03 * rng.standard_normal((70, 32)) for c in centre] + [centre[0] + 0.45 * rng.standard_normal((40, 32)), rng.standard_normal((60, 32))]).astype(np.float32)
    x[5] = x[6] = x[7]
    monkeypatch.setattr(near_vectors, "SIDE", 16)
    monkeypatch.setattr(near_vectors, "TOGETHER", 50)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["id"]: r for r in near_vectors.link(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    n = near.sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.98 * n.sum() and (found[:70] == n[:70]).mean() > 0.5
    groups = near_vectors.clean(df, "vec_id", "embedding").groupBy("v").agg(F.min("id").alias("g"))
    members = near_vectors.dense_classes(groups, 32, 0.9).collect()
    assert len(members) > 100
    by = {}
    for r in members:
        by.setdefault(r["leader"], []).append(r["g"])
    assert all(near[np.ix_(m, m)].all() for m in by.values())
    reach = {i: {i} for i in range(len(x))}
    for i in range(len(x)):
        for j in np.flatnonzero(near[i]):
            if reach[i] is not reach[j]:
                reach[i] |= reach[j]
                for k in reach[j]:
                    reach[k] = reach[i]
    assert sum(got[i]["component_id"] == min(reach[i]) for i in range(len(x))) >= 0.97 * len(x)


def test_links_of_nothing(spark):
    df = frame(spark, rows()[:5])
    assert near_vectors.link(df.limit(0)).count() == 0
    assert near_vectors.link(df.where("vec_id > 9000 and vec_id <> 9007")).count() == 6


def test_blocks_meet(spark):
    """A group far larger than a block: every pair is still met."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal(16) + rng.standard_normal((200, 16)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "g long, v array<double>").withColumn("norm", F.sqrt(near_vectors.dot(F.col("v"), F.col("v"))))
    pairs = near_vectors.near_pairs(df, 200, 16, block=16).select("a", "b")
    assert pairs.distinct().count() == pairs.count() >= 0.97 * 200 * 199 / 2


@pytest.mark.parametrize("n", [10, 10_000, 1_000_000])
def test_calibration(n):
    directions, cut_at, width = near_vectors.calibrate(n)
    rng = np.random.default_rng(2)
    p = 2 * near_vectors.collide(0.9, cut_at, width)
    hits = rng.binomial(directions, p, 20_000)
    assert (hits >= near_vectors.VOTES).mean() >= 0.97
