"""Helpers shared by the corpus operators: reading tables, cutting lineage, size-checked broadcasts, components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when its counted rows take at most so many bytes; rows of 160 bytes, if nothing else is said.
BROADCAST_BYTES, ROW_BYTES = 8_000_000, 160
BROADCAST_ROWS = BROADCAST_BYTES // ROW_BYTES
#: Rows of one key that meet the key's own row in one task.
GROUP_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Lets Python workers started from here import this package wherever the session was started, and takes smaller Arrow batches.

    Both are settings of the session, as Spark has none for an operation: its folder is added to the workers' path, and batches are
    cut from Spark's 10,000 rows to 2,000, as texts are long; a session that sets another number keeps it.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a local session without one (a test) gets its own."""
    ship(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there, so that lost executors can't lose it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df from a table written to the shared folder, and where that is; for large intermediates, as columns pack tighter."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files and checkpoints that nothing refers to any more: it does so only after the driver's JVM
    has collected its garbage, which a large heap puts off while the disks fill."""
    spark._jvm.System.gc()


def small(df: DataFrame, rows: int, width: int = ROW_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows, of `width` bytes each at most, are few enough; otherwise Spark shuffles."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: Column) -> Column:
    """16 bytes that tell rows apart by these columns: two 64-bit hashes, the second of them started from another seed."""
    half = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.unhex(F.concat(half(F.xxhash64(*columns)), half(F.xxhash64(F.lit(7), *columns))))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows joined to groups, which has one row for each key and the number of rows of the key in `count` (dropped).

    Rows of a crowded key are dealt over parts, each of which gets the key's row. rows must be stable (cut).
    """
    hot = cut(groups.where(F.col(count) > GROUP_ROWS).select(key, F.ceil(F.col(count) / GROUP_ROWS).cast("int").alias("__parts")))
    n = hot.count()
    if not n:
        return rows.join(groups.drop(count), key, how)
    parts = F.greatest(F.lit(1), F.ceil(F.col(count) / GROUP_ROWS).cast("int"))
    dealt = rows.withColumn("__nth", F.monotonically_increasing_id()).join(small(hot, n, 32), key, "left")
    dealt = dealt.withColumn("__part", F.pmod("__nth", F.coalesce("__parts", F.lit(1))).cast("int")).drop("__nth", "__parts")
    spread = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return dealt.join(spread, [key, "__part"], how).drop("__part")


def dense_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Adds 0, 1, 2 ... in the order of the columns, without a single-partition sort.

    The driver sees one count per partition, not rows. The input must be cut or otherwise stable.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    counts = sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect())
    start, offsets = 0, []
    for p, c in counts:
        offsets.append((p, start))
        start += c
    pairs = [x for p, s in offsets for x in (F.lit(p), F.lit(s))]
    base = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return ranged.withColumn(name, (base + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__at")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node that it can reach.

    Large-star and small-star contraction (Kiveris et al., 2014) on DataFrames: each round is aggregations and joins by
    node, minima are combined before the shuffle, and the edge list is cut to shared storage every round. The number of
    rounds grows with the logarithm of a component's size; only row counts and sums reach the driver.
    Null ends and self-loops are ignored. Raises RuntimeError if the rounds don't suffice.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u goes to u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(hop.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
    raise RuntimeError("components: not contracted within the given rounds")


def struct_array(kind: str) -> Column:
    return F.array().cast(f"array<struct<{kind}>>")


def tidy() -> None:
    """Called by a worker at the end of a task: hands memory that is free back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
