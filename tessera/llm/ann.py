"""Operator 1: approximate nearest neighbours by inverted lists and an adaptive dimension scan.

Vectors of one length are dealt into ranges of norms, by powers of four around their median norm, and each range is indexed by
itself: a vector of extreme length does not blur the others. Within a range, largest inner product becomes smallest distance by
one more dimension (sqrt(M^2 - |x|^2), M the range's largest norm; 0 for queries). Vectors are rotated at random, so that any
block of dimensions is an unbiased sample of a distance, and put into the list of the nearest centroid. A query probes the
lists nearest to it. Within a list the rotated columns are read in blocks; after each block a hypothesis test compares the
scaled partial distance with the distance of the worst neighbour held, and candidates that are significantly farther are
abandoned. Survivors are scored on the original vectors in double precision, and each block hands on its k + 1 best by score,
then id: no rounding of distances and no tie decides what is left out.

Centroids, rotation and the number of probed lists come from a bounded sample: eight vectors a list, LEAST_SAMPLE at least and
MOST_SAMPLE at most, those of the smallest hashes of their ids; the number of lists grows with the square root of the number of
vectors (up to MOST_SAMPLE / 8). Lists are probed until the neighbours of the sample's own queries lie in them with TARGET
recall. Every row is indexed and every list that a query probes is scanned whole. Lists and queries travel as blocks of bounded
size, and the blocks of a list in groups of GROUP, so that a hot list and its many queries are many tasks. Exact copies are one
indexed vector with its ids; a group needs only its k + 1 smallest ids to answer.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose squared length is beyond
the range of doubles, and rows with a null id take no part;
vectors of different lengths are no candidates for each other; repeated rows (same id) count once, with their smallest vector;
ties go to the smaller id; fewer than k candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small, table
from .vectors import clean, dot

#: Bounds of the sample that lists, rotation and probing are fitted on; vectors in a block; dimensions read at a time.
LEAST_SAMPLE, MOST_SAMPLE, BLOCK, STEP = 8_000, 200_000, 1_024, 16
#: Recall that probing aims at on the sample; width of the hypothesis test in standard errors (ADSampling's epsilon).
TARGET, EPSILON = 0.97, 2.1
#: Blocks of a list that meet blocks of its queries in one task.
GROUP = 8


def sample_size(n: int) -> int:
    """Vectors to fit on, about, for n vectors: eight for each of sqrt(n) / 2 lists."""
    return int(np.clip(4 * np.sqrt(n), LEAST_SAMPLE, MOST_SAMPLE))


def fit(sample: np.ndarray, biggest: float, n: int, k: int, target: float = TARGET) -> tuple[np.ndarray, np.ndarray, int]:
    """(rotation, centroids, lists to probe) from sample vectors; n is the number of vectors to be indexed."""
    rng = np.random.default_rng(17)
    d = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = lift(sample, biggest) @ rotation
    lists = int(np.clip(np.sqrt(n) / 2, 1, max(1, len(x) // 8)))
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(10):
        own = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=lists)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    own = nearest(x, centroids)
    asked = rng.choice(len(x), min(len(x), 400), replace=False)
    q = np.hstack([sample[asked], np.zeros((len(asked), 1))]) @ rotation
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, 1, kind="stable")[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(distances(q, centroids), 1), 1)
    needed = np.sort(rank[np.arange(len(asked))[:, None], own[best]].ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1 if len(needed) else 1
    return rotation, centroids, min(lists, probes)


def lift(x: np.ndarray, biggest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, biggest**2 - (x * x).sum(1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, all against all, of two bounded blocks."""
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(distances(x[i : i + 4096], centroids), 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=int)


def scan(queries: np.ndarray, rows: np.ndarray, k: int, bound: np.ndarray, step: int = STEP, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the candidates that survive the adaptive dimension scan of one block.

    bound: for each query a squared distance within which k neighbours are known to lie (inf if none is known). The first
    rows of the block are measured in full to tighten it.
    """
    d = rows.shape[1]
    head = min(len(rows), max(2 * k, 64))
    full = distances(queries, rows[:head])
    if head >= k:
        bound = np.minimum(bound, np.partition(full, k - 1, axis=1)[:, k - 1])
    qi, ri = np.nonzero(full <= bound[:, None])
    found = [(qi, ri, full[qi, ri])]
    if len(rows) > head:
        rest = rows[head:]
        part = distances(queries[:, :step], rest[:, :step])
        limit = bound * (step / d) * (1 + epsilon / np.sqrt(step)) ** 2 if step < d else bound
        qi, ri = np.nonzero(part <= limit[:, None])
        part, at = part[qi, ri], step
        while at < d and len(qi):
            to = min(d, at + step)
            diff = queries[qi, at:to] - rest[ri, at:to]
            part, at = part + np.einsum("ij,ij->i", diff, diff), to
            # the test of the hypothesis that the whole distance is within the bound; exact at the last block
            limit = bound[qi] * (at / d) * (1 + epsilon / np.sqrt(at)) ** 2 if at < d else bound[qi]
            stay = part <= limit
            qi, ri, part = qi[stay], ri[stay], part[stay]
        found.append((qi, ri + head, part))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best_scores(q: np.ndarray, g: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, by score, then by id."""
    order = np.lexsort((g, -score, q))
    start = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0]) if len(order) else np.zeros(0, int)
    at = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[at < k]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of length d from a list column or from bytes of doubles."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, d)


class Range:
    """The index of the vectors of one length and one range of norms."""

    def __init__(self, groups: DataFrame, n: int, biggest: float, d: int, k: int, sample: int | None, block: int, target: float):
        self.groups, self.n, self.biggest, self.d, self.k, self.block = groups, n, biggest, d, k, block
        most = sample or sample_size(n)
        share = F.pmod(F.xxhash64("g", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.9 * most / n)) if n > most else F.lit(True)
        taken = groups.where(share).orderBy("g").limit(most).select("g", "v").collect() or groups.orderBy("g").limit(1).select("g", "v").collect()
        self.few, self.few_g = np.array([r[1] for r in taken]), np.array([r[0] for r in taken], dtype=np.int64)
        self.rotation, self.centroids, self.probes = fit(self.few, biggest, n, k, target)

    def in_blocks(self, df: DataFrame, key: str, *cols: str) -> DataFrame:
        """(list, team, x): rows of each list, dealt into blocks of about `block` rows; GROUP blocks are a team."""
        df = cut(df)
        sized = df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / self.block).cast("int").alias("parts"))
        dealt = df.join(small(sized, len(self.centroids)), "list").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
        return dealt.groupBy("list", "part").agg(F.collect_list(F.struct(key, *cols)).alias("x")).select("list", F.floor(F.col("part") / GROUP).cast("int").alias("team"), "x")

    def nearest(self, asked: DataFrame) -> DataFrame:
        """(q, g, score) of the k + 1 best of each query (q, v, kth), as found; kth: a score that k + 1 others reach, or null."""
        d, k, biggest, rotation, centroids, few, few_g = self.d, self.k, self.biggest, self.rotation, self.centroids, self.few, self.few_g
        probes = self.probes

        def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(1), d)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest(lift(x, biggest) @ rotation, centroids), pa.int32()), pa.array([y.tobytes() for y in x.astype("<f8")], pa.binary())], names=["g", "list", "x"])

        def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    part = b.slice(i, 512)
                    x = _matrix(part.column(1), d)
                    lists = np.argsort(distances(np.hstack([x, np.zeros((len(x), 1))]) @ rotation, centroids), 1, kind="stable")[:, :probes]
                    m = lists.shape[1]
                    raw = [y.tobytes() for y in x.astype("<f8")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), m)), pa.array(lists.ravel().astype(np.int32)), pa.array([y for y in raw for _ in range(m)], pa.binary()), pa.array(np.tile(np.arange(m, dtype=np.int32), part.num_rows))], names=["q", "list", "x", "nth"])

        def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The best of the sample are candidates like any other, and bound the first lists."""
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    part = b.slice(i, 512)
                    score = _matrix(part.column(1), d) @ few.T
                    m = min(k + 1, len(few))
                    at = np.argpartition(-score, m - 1, axis=1)[:, :m]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), m)), pa.array(few_g[at].ravel()), pa.array(np.take_along_axis(score, at, 1).ravel())], names=["q", "g", "score"])

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x, y in zip(b.column(0), b.column(1), strict=True):
                    rows, asks = x.values, y.values
                    g, v = rows.field("g").to_numpy(), _matrix(rows.field("x"), d)
                    q, qv, kth = asks.field("q").to_numpy(), _matrix(asks.field("x"), d), asks.field("kth").to_numpy(zero_copy_only=False)
                    far_most = (qv * qv).sum(1) + biggest**2
                    bound = np.where(np.isnan(kth), np.inf, far_most - 2 * np.nan_to_num(kth))
                    # single precision orders distances up to its error only: what may be among the k + 1 best is scored
                    slack = 1e-5 * far_most
                    rotated = (np.hstack([qv, np.zeros((len(qv), 1))]) @ rotation).astype("<f4"), (lift(v, biggest) @ rotation).astype("<f4")
                    qi, ri, far = scan(*rotated, k + 1, (np.maximum(bound, 0) + slack).astype("<f4"))
                    order = np.lexsort((far, qi))
                    start = np.flatnonzero(np.r_[True, np.diff(qi[order]) != 0]) if len(order) else np.zeros(0, int)
                    size = np.diff(np.r_[start, len(order)])
                    last = far[order][start + np.minimum(size, k + 1) - 1] if len(order) else far
                    near = order[far[order] <= np.repeat(last, size) + slack[qi[order]]]
                    qi, ri = qi[near], ri[near]
                    score = np.einsum("ij,ij->i", qv[qi], v[ri])
                    stay = best_scores(qi, g[ri], score, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(q[qi[stay]], pa.int64()), pa.array(g[ri[stay]], pa.int64()), pa.array(score[stay])], names=["q", "g", "score"])

        blocks = cut(self.in_blocks(self.groups.select("g", "v").mapInArrow(indexed, "g long, list int, x binary"), "g", "x"))
        teams = cut(blocks.select("list", "team").distinct())
        probed = cut(asked.select("q", "v").mapInArrow(probing, "q long, list int, x binary, nth int"))

        def scan_lists(asking: DataFrame) -> DataFrame:
            asking = self.in_blocks(asking.select("q", "list", "x", "kth"), "q", "x", "kth")
            # a team of the queries' blocks goes to each team of the list's blocks, and the other way round
            ask_teams = asking.select("list", F.col("team").alias("ask_team")).distinct()
            mine = blocks.join(ask_teams, "list").withColumnRenamed("x", "rows")
            theirs = asking.select("list", F.col("team").alias("ask_team"), F.col("x").alias("asks")).join(teams, "list")
            return mine.join(theirs, ["list", "team", "ask_team"]).select("rows", "asks").mapInArrow(scanned, "q long, g long, score double")

        def top(found: DataFrame) -> DataFrame:
            nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "g"))
            return found.groupBy("q", "g").agg(F.max("score").alias("score")).withColumn("nth", nth).where(F.col("nth") <= k + 1)

        # The nearest lists first; what they hold tightens the bounds that all other lists are scanned with.
        ahead = max(1, probes // 8)
        seeds = cut(asked.select("q", "v").mapInArrow(seeded, "q long, g long, score double"))
        first = cut(seeds.union(scan_lists(probed.where(F.col("nth") < ahead).join(self.tighter(asked, seeds), "q"))))
        rest = scan_lists(probed.where(F.col("nth") >= ahead).join(self.tighter(asked, first), "q"))
        return cut(top(first.union(rest)).select("q", "g", "score"))

    def tighter(self, asked: DataFrame, found: DataFrame) -> DataFrame:
        """(q, kth) from what is known and the k + 1 best of what was found."""
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "g"))
        got = found.groupBy("q", "g").agg(F.max("score").alias("score")).withColumn("nth", nth).where(F.col("nth") == self.k + 1)
        return asked.select("q", "kth").join(got.select("q", "score"), "q", "left").select("q", F.greatest("kth", "score").alias("kth"))


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int | None = None, block: int = BLOCK, target: float = TARGET) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k rows of largest inner product, itself left out by id."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    # one row an id: the smallest vector, if rows with one id differ
    rows = clean(vectors, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    square = dot(F.col("v"), F.col("v"))
    rows = rows.where((square > 0) & (square < float("inf")))
    # exact copies are one vector: v, its k + 1 smallest ids
    groups = rows.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")).withColumn("g", F.element_at("ids", 1))
    groups = cut(groups.withColumn("d", F.size("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))))
    middle = groups.groupBy("d").agg(F.percentile_approx("norm", 0.5).alias("middle"))  # one row a length
    ranged = groups.join(middle, "d").withColumn("range", F.floor(F.log2(F.col("norm") / F.col("middle")) / 2 + 0.5).cast("int"))
    ranges = ranged.groupBy("d", "range").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("biggest")).collect()
    asked = queries.select(F.col(id_col).cast("long").alias("query_id")).distinct()
    # the distinct vectors of the queries: a group of copies is asked once
    query_rows = cut(rows.join(asked, F.col("id") == F.col("query_id"), "left_semi"))
    query_groups = cut(query_rows.select("v").distinct().withColumn("q", F.monotonically_increasing_id()))
    lengths = {r[0] for r in query_groups.select(F.size("v")).distinct().collect()}
    found = None
    # long vectors first, as what they score bounds the shorter ones
    for d, at, n, biggest in sorted((r for r in ranges if r[0] in lengths), key=lambda r: (r[0], -r[1])):
        held = cut(ranged.where((F.col("d") == d) & (F.col("range") == at)).select("g", "v")) if len(ranges) > 1 else groups.select("g", "v")
        index = Range(held, n, biggest, d, k, sample, block, target)
        these = query_groups.where(F.size("v") == d).withColumn("kth", F.lit(None).cast("double"))
        got = index.nearest(cut(these.drop("kth").join(index.tighter(these, found), "q")) if found is not None else these)
        found = cut(found.union(got)) if found is not None else got
    if found is None:
        return empty
    # a group that many queries found is one row of ids, so its rows are dealt over the queries' hashes by the join itself
    scored = found.join(groups.select("g", "ids"), "g").select("q", "score", "ids")
    each = scored.join(query_groups.select("q", F.col("v").alias("qv")), "q").join(query_rows.select(F.col("v").alias("qv"), F.col("id").alias("query_id")), "qv")
    each = each.select("query_id", "score", F.explode("ids").alias("id")).where("id <> query_id")
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return top.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0), 20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
