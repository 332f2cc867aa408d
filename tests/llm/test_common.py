"""Components and dense numbering."""

import random

from tessera.llm.common import components, cut, dense_index, written


def brute(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(300)]  # a chain
    edges += [(5000, 5001 + i) for i in range(800)] + [(-7, 5100)]  # a star with a smaller end
    edges += [(3, 3), (None, 4), (4, None), (5, 6), (6, 5), (5, 6)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == brute(edges) and len(got) == len(brute(edges))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_index(spark):
    names = ["b", "a", None, "é", "Z", "zz", "a b"] + [f"n{i:03d}" for i in range(100)]
    df = cut(spark.createDataFrame([(n,) for n in names], "source string"))
    got = {r["source"]: r["idx"] for r in dense_index(df, "source").collect()}
    assert got == {n: i for i, n in enumerate([*sorted((n for n in names if n is not None), key=str.encode), None])}
    assert dense_index(df.limit(0), "source").count() == 0


def test_written(spark):
    df, folder = written(spark.range(5).toDF("x"))
    assert sorted(r[0] for r in df.collect()) == [0, 1, 2, 3, 4] and folder
