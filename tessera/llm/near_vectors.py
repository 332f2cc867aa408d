"""Operator 8: near-duplicate embeddings by collision counting over many sorted one-dimensional projections.

Unit vectors are projected on many random directions. Each direction orders them; of each order the two ends are kept
(projections beyond a cut that a share `tail` of a normal distribution exceeds), as only there do unlike vectors lie far
apart. Around each kept vector a window of half-width `width` holds its collisions on that direction. Collisions are
counted per pair over all directions, and pairs with at least `votes` of them are verified by cosine on the original
vectors. For two vectors of a given cosine the projections are bivariate normal whatever the data, so the number of
directions is calibrated: so many that a pair right at the limit reaches the count with probability `recall`.

The share of the ends shrinks with the square root of the number of vectors, so directions, kept projections and random
collisions grow as n^1.5. Exact copies are one vector with a count. Collisions travel as lists, one for each kept projection, and
are counted list by list, so no row is made for a pair that collides too seldom. The ends of a direction that hold many vectors
are dealt into blocks, and each pair of blocks of an end has a key of its own.

Dense groups: vectors that share a code of signs of random projections and lie within a quarter of the limit's angle of one of
them are a class, if they are DENSE at least. The members of a class are linked with each other for certain, so a class is one row
with a weight; only its leader is searched, with a limit widened by the radii. Two classes, or a class and a vector, whose leaders
are near enough are linked as a whole, by arithmetic; those that are not far enough for none are compared in blocks, which hand on
one sum a vector. So no row stands for a link within a dense group.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing (n_links 0, a
component of their own), as do vectors of different lengths; a null id is kept as such with no links;
rows with the same id are one vector (the smallest of them); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, comb, cos, erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, join_groups, small, table
from .vectors import clean, dot

COSINE = 0.9
#: Probability that a pair right at the limit is counted often enough; collisions asked for; window in units of a
#: pair's typical difference of projections; vectors of one end of a direction in a block; directions a task multiplies by.
RECALL, VOTES, WIDTH, BLOCK, DIRECTIONS = 0.98, 2, 2.5, 512, 512
#: Sign bits of the codes that dense groups are looked for by; members that a class has at least; its radius in limit angles; rows of a
#: code that are looked at together; vectors of a class compared at a time.
SIGNS, DENSE, TIGHT, TOGETHER, SIDE = 24, 16, 0.25, 2_000, 512
#: Collisions that a task holds, about, before it hands them on.
PAIRS = 1 << 19


def _above(z: float) -> float:
    return 0.5 * (1 - erf(z / sqrt(2)))


def cut_of(tail: float) -> float:
    """The value that a standard normal variable exceeds with probability tail."""
    low, high = -1.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _above(mid) > tail else (low, mid)
    return high


def collide(cosine: float, cut_at: float, width: float) -> float:
    """Probability that two projections with this correlation both exceed the cut and differ by at most width."""
    rest, total, steps, top = sqrt(1 - cosine**2), 0.0, 4000, cut_at + 8
    for i in range(steps):
        x = cut_at + (top - cut_at) * (i + 0.5) / steps
        low, high = (max(cut_at, x - width) - cosine * x) / rest, (x + width - cosine * x) / rest
        total += exp(-x * x / 2) / sqrt(2 * pi) * (_above(low) - _above(high)) * (top - cut_at) / steps
    return total


def calibrate(n: int, cosine: float = COSINE, recall: float = RECALL, votes: int = VOTES) -> tuple[int, float, float]:
    """(directions, cut, half-width of windows); each direction has two ends, which are two independent orders."""
    tail = min(0.02, 0.1 / sqrt(max(1, n)))
    cut_at, width = cut_of(tail), WIDTH * sqrt(2 - 2 * cosine)
    p = 2 * collide(cosine, cut_at, width)
    few = lambda m: sum(comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(votes))
    high = max(votes, int(1 / p))
    while few(high) > 1 - recall:
        high *= 2
    low = 0
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if few(mid) > 1 - recall else (low, mid)
    return high, cut_at, width


def ends_of(unit: np.ndarray, directions: int, cut_at: float, at_a_time: int = DIRECTIONS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, end, projection) of the projections beyond the cut; end 2j and 2j + 1 are the two ends of direction j."""
    d = unit.shape[1]
    x = unit.astype(np.float32)
    for start in range(0, directions, at_a_time):
        rng = np.random.default_rng([start, d])
        p = x @ rng.standard_normal((d, min(at_a_time, directions - start)), dtype=np.float32)
        row, j = np.nonzero(np.abs(p) > cut_at)
        value = p[row, j]
        yield row, 2 * (start + j) + (value < 0), np.abs(value)


def window_pairs(a: np.ndarray, b: np.ndarray, width: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in sorted a, in sorted b) that lie within each other's windows; within one block each pair once."""
    low = np.searchsorted(b, a - width, "left") if not same else np.arange(1, len(a) + 1)
    size = np.maximum(0, np.searchsorted(b, a + width, "right") - low)
    i = np.repeat(np.arange(len(a)), size)
    j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    return i, j


def near_pairs(groups: DataFrame, n: int, d: int, cosine: float = COSINE, recall: float = RECALL, votes: int = VOTES, block: int = BLOCK, led: bool = False) -> DataFrame:
    """(a, b, cosine) with a < b of the pairs of rows of groups (g, v, norm) found at the cosine or above.

    led: groups has a column `leads`, and only pairs with a row that leads are wanted.
    """
    directions, cut_at, width = calibrate(n, cosine, recall, votes)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                x = unit(b.column(1), d)
                ids, leads = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
                for row, end, value in ends_of(x, directions, cut_at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(end.astype(np.int64)), pa.array(value.astype(np.float32)), pa.array(leads[row])], names=["g", "e", "p", "leads"])

    kept = cut(groups.select("g", "v", F.col("leads") if led else F.lit(True).alias("leads")).repartition(max(1, min(n // 500, 4 * groups.sparkSession.sparkContext.defaultParallelism, 10_000)), "g").mapInArrow(projected, "g long, e long, p float, leads boolean"))
    crowded = cut(kept.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("e", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    some = crowded.count()
    dealt = kept.join(F.broadcast(crowded) if some <= 50_000 else crowded, "e", "left").withColumn("part", F.pmod(F.xxhash64("g"), F.coalesce("parts", F.lit(1))).cast("int"))
    blocks = dealt.groupBy("e", "part").agg(F.first("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("p", "g", "leads"))).alias("x"))
    blocks = blocks.select("e", "part", "parts", F.col("x.p").alias("p"), F.col("x.g").alias("g"), F.col("x.leads").alias("leads"))

    def gathered(some: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """The collisions of several blocks, by the smaller vector of each: (a, its partners, with repeats)."""
        a, b = (np.concatenate([x[k] for x in some]) if some else np.zeros(0, np.int64) for k in range(2))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, np.diff(a) != 0]) if len(a) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[first], pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[first, len(a)].astype(np.int32)), pa.array(b, pa.int64()))], names=["a", "b"])

    def collided(batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                p, g, first, q, h, second = (x.values.to_numpy(zero_copy_only=False) for x in (row * 2 if same else row))
                i, j = window_pairs(p, q, width, same)
                if led:
                    wanted = first[i] | second[j]
                    i, j = i[wanted], j[wanted]
                held.append((np.minimum(g[i], h[j]), np.maximum(g[i], h[j])))
                size += len(i)
                if size > PAIRS:
                    yield gathered(held)
                    held, size = [], 0
        yield gathered(held)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs with votes enough, from each vector's lists."""
        for batch in batches:
            for a, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b, n = np.unique(lists.values.flatten().to_numpy(), return_counts=True)
                b = b[n >= votes]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a, dtype=np.int64)), pa.array(b)], names=["a", "b"])

    lists = blocks.select("p", "g", "leads").mapInArrow(lambda x: collided(x, True), "a long, b array<long>")
    if some:
        split = cut(blocks.where(F.col("parts") > 1))
        ends = split.select("e", "part", "parts", "p", "g", "leads")
        sent = ends.withColumn("part2", F.explode(F.sequence(F.col("part") + 1, F.col("parts")))).where(F.col("part2") < F.col("parts")).select("e", "part", "part2", "p", "g", "leads")
        other = ends.where("part > 0").withColumn("part1", F.explode(F.sequence(F.lit(0), F.col("part") - 1))).select("e", F.col("part1").alias("part"), F.col("part").alias("part2"), F.col("p").alias("q"), F.col("g").alias("h"), F.col("leads").alias("leads2"))
        met = sent.join(other, ["e", "part", "part2"]).select("p", "g", "leads", "q", "h", "leads2")
        lists = lists.union(met.mapInArrow(lambda x: collided(x, False), "a long, b array<long>"))
    often = lists.groupBy("a").agg(F.collect_list("b").alias("b")).mapInArrow(counted, "a long, b long")
    left = groups.select(F.col("g").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"))
    right = groups.select(F.col("g").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    both = often.join(left, "a").join(right, "b").withColumn("cosine", dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb")))
    return both.where(F.col("cosine") >= cosine).select("a", "b", "cosine")


def unit(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of length 1 from a list column."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def dense_classes(groups: DataFrame, d: int, cosine: float) -> DataFrame:
    """(g, leader, angle) of the members of dense classes; angle: between member and leader."""
    radius = TIGHT * acos(cosine)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng([29, d]).standard_normal((d, SIGNS))
        for b in batches:
            if b.num_rows:
                bits = (unit(b.column(1), d) @ planes > 0) @ (1 << np.arange(SIGNS, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.int64())], names=["g", "code"])

    def classes(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("g").combine_chunks()
        g, x = part.column("g").to_numpy(), unit(part.column("v").combine_chunks(), d)
        left, out = np.arange(len(g)), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        while len(left) >= DENSE:
            near = np.clip(x[left] @ x[left[0]], -1, 1)
            own = near >= np.cos(radius)
            own[0] = True
            if own.sum() >= DENSE:
                out.append((g[left[own]], np.full(own.sum(), g[left[0]]), np.where(left[own] == left[0], 0.0, np.arccos(near[own]))))
                left = left[~own]
            else:
                left = left[1:]
        return pa.table({n: np.concatenate([x[k] for x in out]) for k, n in enumerate(("g", "leader", "angle"))})

    codes = cut(groups.select("g", "v").mapInArrow(coded, "g long, code long"))
    crowded = cut(codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DENSE).select("code", F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts")))
    n = crowded.count()
    some = codes.join(small(crowded, n, 16), "code").withColumn("part", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int"))
    return some.join(groups.select("g", "v"), "g").select("g", "v", "code", "part").groupBy("code", "part").applyInArrow(classes, "g long, leader long, angle double")


def with_classes(groups: DataFrame, n: int, d: int, cosine: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """((g, others), (a, b)): the weight n of the vectors that each row of groups (g, v, norm, n) is linked with, its own copies aside;
    and pairs whose components are those of all links."""
    limit, slack = acos(cosine), 1e-6
    member = cut(dense_classes(groups, d, cosine).join(groups.select("g", "n"), "g"))
    classes = cut(member.groupBy("leader").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius")))
    k = classes.count()
    single = cut(groups.join(member.select("g"), "g", "left_anti")) if k else groups
    alone = cut(near_pairs(single, n, d, cosine, recall)) if n > 1 else None
    weight = groups.select("g", "n")
    sums, edges = [], []
    if alone is not None:
        both = alone.select("a", "b").union(alone.select(F.col("b").alias("a"), F.col("a").alias("b")))
        sums.append(both.join(weight.withColumnRenamed("g", "b"), "b").select(F.col("a").alias("g"), F.col("n").alias("others")))
        edges.append(alone.select("a", "b"))
    if k:
        edges.append(member.where("g <> leader").select(F.col("g").alias("a"), F.col("leader").alias("b")))
        # every vector that is searched for, as a class of one or more
        items = cut(single.select("g", "v", "norm", F.col("n").alias("weight"), F.lit(0.0).alias("radius"), F.lit(False).alias("leads")).union(groups.drop("n").join(classes.withColumnRenamed("leader", "g"), "g").select("g", "v", "norm", "weight", "radius", F.lit(True).alias("leads"))))
        wide = cos(limit * (1 + 2 * TIGHT) + slack)
        side = lambda x: items.select(F.col("g").alias(x), F.col("weight").alias(f"w{x}"), F.col("radius").alias(f"r{x}"))
        found = cut(near_pairs(items, n, d, wide, recall, led=True).join(side("a"), "a").join(side("b"), "b").withColumn("angle", F.acos(F.least(F.lit(1.0), "cosine"))).withColumn("reach", F.col("ra") + F.col("rb")))
        whole = found.where(F.col("angle") + F.col("reach") <= limit - slack)
        edges.append(whole.select("a", "b"))
        by_class = whole.select(F.col("a").alias("leader"), F.col("wb").alias("others")).union(whole.select(F.col("b").alias("leader"), F.col("wa").alias("others"))).groupBy("leader").agg(F.sum("others").alias("others"))
        # a class's members are linked with each other and with all that its class is linked with as a whole
        own = classes.join(by_class, "leader", "left").select("leader", "rows", (F.col("weight") + F.coalesce("others", F.lit(0))).alias("others"))
        sums.append(join_groups(member.select("g", "n", "leader"), own, "leader", "rows").select("g", (F.col("others") - F.col("n")).alias("others")))
        sums.append(by_class.join(classes.select("leader"), "leader", "left_anti").select(F.col("leader").alias("g"), "others"))
        open_pairs = found.where((F.col("angle") + F.col("reach") > limit - slack) & (F.col("angle") - F.col("reach") <= limit + slack)).select("a", "b")
        counted = cut(_compared(open_pairs, groups, member, cosine, d))
        sums.append(counted.where("other is null").select("g", "others"))
        edges.append(counted.where("other is not null").select(F.col("g").alias("a"), F.col("other").alias("b")))
    others = reduce(DataFrame.union, sums).groupBy("g").agg(F.sum("others").alias("others")) if sums else weight.select("g", F.lit(0).cast("long").alias("others")).limit(0)
    pairs = reduce(DataFrame.union, edges) if edges else weight.select(F.col("g").alias("a"), F.col("g").alias("b")).limit(0)
    return others, pairs


def _compared(open_pairs: DataFrame, groups: DataFrame, member: DataFrame, cosine: float, d: int) -> DataFrame:
    """(g, others, other): what each member of the classes a and b of open_pairs is linked with in the other class; or, with
    `other`, a link between the two classes, enough of them for their components. Blocks of members meet blocks of members."""
    grouped = member.select("g", "leader").join(groups.select("g", "v", "norm", "n"), "g")
    solo = groups.join(member.select("g"), "g", "left_anti").select("g", F.col("g").alias("leader"), "v", "norm", "n")
    sized = member.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("parts"))
    packed = grouped.join(sized, "leader").withColumn("part", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int")).drop("parts").unionByName(solo.withColumn("part", F.lit(0)))
    wanted = open_pairs.select(F.col("a").alias("leader")).union(open_pairs.select(F.col("b").alias("leader"))).distinct()
    sides = cut(packed.join(wanted, "leader", "left_semi").groupBy("leader", "part").agg(F.collect_list(F.struct("g", "n", "norm", "v")).alias("x")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                (g, n, v), (h, m, w) = ((s.values.field("g").to_numpy(), s.values.field("n").to_numpy(), s.values.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) / s.values.field("norm").to_numpy()[:, None]) for s in (x, y))
                near = v @ w.T >= cosine
                mine, theirs = near @ m, near.T @ n
                # one link of each vector that has any joins it to the other class
                i, j = np.flatnonzero(mine), np.flatnonzero(theirs)
                ids = np.concatenate([g[i], h[j], g[i], h[j]])
                others = np.concatenate([mine[i], theirs[j], np.zeros(len(i) + len(j), np.int64)])
                other = np.concatenate([np.full(len(i) + len(j), -1), h[near[i].argmax(1)] if len(i) else h[:0], g[near[:, j].argmax(0)] if len(j) else g[:0]])
                link = np.arange(len(ids)) >= len(i) + len(j)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others.astype(np.int64)), pa.array(other.astype(np.int64), pa.int64(), mask=~link)], names=["g", "others", "other"])

    met = open_pairs.join(sides.select(F.col("leader").alias("a"), "x"), "a").join(sides.select(F.col("leader").alias("b"), F.col("x").alias("y")), "b")
    return met.select("x", "y").mapInArrow(compare, "g long, others long, other long")


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) for every id."""
    ids = vectors.select(F.col(id_col).cast("long").alias("id")).distinct()
    rows = clean(vectors, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    member = cut(rows.withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)))
    groups = cut(member.groupBy("key").agg(F.min("id").alias("g"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))))
    lengths = sorted((r[0], r[1]) for r in groups.groupBy(F.size("v")).count().collect())  # one row a length
    if not lengths:
        return ids.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    each = [with_classes(groups.where(F.size("v") == d).drop("key"), n, d, cosine, recall) for d, n in lengths]
    linked, pairs = (reduce(DataFrame.union, x) for x in zip(*each, strict=True))
    joined = components(pairs)
    per = groups.select("g", "n", "key").join(linked, "g", "left").join(joined, F.col("g") == F.col("node"), "left")
    per = per.select("key", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "g").alias("component_id"))
    found = join_groups(member.select("id", "key"), per, "key", "n").select("id", "n_links", "component_id")
    out = ids.join(found, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op8_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP8_SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.a LEFT JOIN n ON e.vec_id = n.a
"""
