"""Operator 3: similarity join of word shingle sets by adaptive multi-match prefixes.

All tokens (shingles) are put into one order, rare ones first, from document counts in a fixed number of hash buckets.
If two sets are similar enough, they share at least l tokens within their l-prefixes, for any l; a longer prefix costs more
postings and leaves fewer candidates. Each document gets the l of least estimated cost from the lengths of its own posting
lists, probes the smaller documents with it, and asks for l common prefix tokens before a candidate is verified on
the whole sets. Documents with equal sets are one set; links make components.

Nothing is emitted per pair but verified links (a spanning forest of them): posting lists travel in chunks, a probe's
partners as one array per list, candidates are gathered by blocks of neighbouring documents, and blocks meet blocks.

Defined results: null text and text without words have no shingles and link with nothing; with fewer words than a shingle has
the whole sequence is the one shingle; repeated ids are answered row by row; a null id never becomes a component's name
unless the component has no other; an empty table gives an empty result; more columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, dense_index, fresh, join_groups, released, remove, row_key, small, table, tidy, written

WORDS, PERCENT = 3, 90
#: Hash buckets of the token counts (a table of fixed size); the longest l; cost of verifying one candidate, in postings for
#: each token of the probe: two sets of 8 bytes a token travel, where a posting has about 40 bytes.
BUCKETS, LONGEST, VERIFY = 1 << 18, 8, 0.4
#: Postings in a chunk; documents in a block; words whose hashes a task remembers.
CHUNK, BLOCK, REMEMBERED = 1_024, 128, 150_000
#: Prefix tokens that a slab holds, within a text; tokens that are counted in one group.
SLAB, GROUP = 1 << 19, 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


class Shingler:
    """Sorted arrays of the 64-bit hashes of a text's distinct shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, split = self.known, (text or "").encode().translate(_LOWER).split()
        if not split:
            return np.zeros(0, dtype=np.uint64)
        if len(known) > REMEMBERED:
            known.clear()
        get, hashes = known.get, []
        for w in split:
            h = get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, dtype=np.uint64)
        if len(h) < self.words:
            return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=1)], dtype=np.uint64)
        out = h[: len(h) - self.words + 1].copy()
        for k in range(1, self.words):
            out = (out ^ (out >> _C)) * _A + h[k : len(h) - self.words + 1 + k] * _B
        out = (out ^ (out >> _C)) * _A
        return np.unique(out ^ (out >> _C))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64, copy=False).view(np.int64))


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (tokens & np.uint64(buckets - 1)).astype(np.int64)


def need(n: np.ndarray | int, percent: int):
    """Tokens that a set of n shares with any set as similar as asked."""
    return -(-(n * percent) // 100)


def _length(n: np.ndarray | int, percent: int, longest: int):
    """Tokens of the longest prefix of a set of n."""
    return np.minimum(n, n - need(n, percent) + longest)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _digest(tokens: np.ndarray) -> bytes:
    """What tells sets apart: 128 bits of a hash of the sorted tokens."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _sets(docs: DataFrame, shingler_words: int, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """((id, key, s, n), token counts by bucket) from (id, text, key): s is a hash of the whole set."""
    slices = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts, names = Shingler(shingler_words), np.zeros(buckets, dtype=np.int64), ["id", "key", "s", "n", "slice", "counts"]
        for batch in batches:
            s, n = [], []
            for text in batch.column(1):
                tokens = shingle(text.as_py())
                counts += np.bincount(_bucket(tokens, buckets), minlength=buckets) if len(tokens) > buckets // 8 else 0
                if len(tokens) <= buckets // 8:
                    np.add.at(counts, _bucket(tokens, buckets), 1)
                s.append(_digest(tokens))
                n.append(len(tokens))
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.binary()), pa.array(n, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        parts = counts.reshape(slices, -1)
        yield pa.RecordBatch.from_arrays([pa.nulls(slices, pa.int64()), *[pa.nulls(slices, pa.binary())] * 2, pa.nulls(slices, pa.int64()), pa.array(range(slices), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in parts], pa.binary())], names=names)
        tidy()

    def added(key: tuple, part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype="<i8") for x in part.column("counts"))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    both = cut(docs.mapInArrow(run, "id long, key binary, s binary, n long, slice int, counts binary"))
    rows = both.where(F.col("slice").isNotNull()).select("slice", "counts").groupBy("slice").applyInArrow(added, "slice int, counts binary").collect()  # BUCKETS numbers
    total = np.zeros((slices, buckets // slices), dtype=np.int64)
    for r in rows:
        total[r[0]] = np.frombuffer(r[1], dtype="<i8")
    return both.where(F.col("slice").isNull()).select("id", "key", "s", "n"), total.ravel()


def _planes(a: np.ndarray) -> bytes:
    """32-bit numbers as all first bytes, all second ones and so on: sorted or small ones pack well so."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _asked(tokens: np.ndarray, groups: int) -> np.ndarray:
    """Where tokens are counted: a group above 32 bits of the token. Tokens that fall together only count as less rare."""
    low = np.uint64(0xFFFFFFFF)
    return ((tokens & low) % np.uint64(groups) << np.uint64(32)) | tokens >> np.uint64(32)


def _posted(texts: DataFrame, counts: np.ndarray, words: int, percent: int, longest: int) -> DataFrame:
    """(s, n, l, idx, tokens, about): one row for each set that shares a token of its prefix with another row, with these tokens
    only; about: documents that have the token, times 256, plus its level. l: the level of least cost; idx: 0, 1, 2 ...

    Most tokens of a prefix occur once and are worth no posting. Prefixes stay in slabs of many texts; a slab asks with 32 bits
    a token how often they occur, groups of tokens answer slab by slab, and what is found once is dropped where it stands.
    """
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, names = Shingler(words), held.value, ["slab", "s", "n", "tokens", "held"]
        slab, s, n, at, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def packed() -> pa.RecordBatch:
            cells = [slab, b"".join(s), np.array(n, dtype="<i8").tobytes(), np.concatenate(at).astype("<u8").tobytes(), size]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cells, kinds, strict=True)], names=names)

        for batch in batches:
            for text in batch.column(0):
                tokens = shingle(text.as_py())
                if not len(tokens):
                    continue
                count = seen[_bucket(tokens, BUCKETS)]
                s.append(_digest(tokens))
                n.append(len(tokens))
                at.append(tokens[np.lexsort((tokens, count))[: _length(len(tokens), percent, longest)]])
                size += len(at[-1])
                if size >= SLAB:
                    yield packed()
                    slab, s, n, at, size = slab + 1, [], [], [], 0
        if size:
            yield packed()
        tidy()

    slabs, place = written(texts.select("text").mapInArrow(prefixes, "slab long, s binary, n binary, tokens binary, held long"))
    groups = max(1, -(-(slabs.agg(F.sum("held")).first()[0] or 0) // GROUP))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab, tokens in zip(batch.column(0), batch.column(1), strict=True):
                keys, times = np.unique(_asked(np.frombuffer(tokens.as_py(), dtype="<u8"), groups), return_counts=True)
                group = (keys >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, np.diff(group) != 0])
                ends = list(zip(first, np.r_[first[1:], len(keys)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[first].astype(np.int32)), pa.array([slab.as_py()] * len(first), pa.int64()), pa.array([_planes(keys[i:j]) for i, j in ends], pa.binary()), pa.array([_planes(times[i:j]) for i, j in ends], pa.binary())],
                    names=["group", "slab", "keys", "times"],
                )
        tidy()

    def answer(key: tuple, part: pa.Table) -> pa.Table:
        asked = [_numbers(x.as_py()) for x in part.column("keys")]
        _, at = np.unique(np.concatenate(asked), return_inverse=True)
        df = np.bincount(at, weights=np.concatenate([_numbers(x.as_py()) for x in part.column("times")])).astype(np.uint32)[at]
        cells = [_planes(x) for x in np.split(df, np.cumsum([len(x) for x in asked])[:-1])]
        return pa.table({"slab": part.column("slab"), "group": part.column("group"), "df": pa.array(cells, pa.binary())})

    answers = slabs.select("slab", "tokens").mapInArrow(ask, "group int, slab long, keys binary, times binary").groupBy("group").applyInArrow(answer, "slab long, group int, df binary")
    told = slabs.join(answers.groupBy("slab").agg(F.collect_list(F.struct("group", "df")).alias("df")), "slab").select("s", "n", "tokens", "df")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, names = np.arange(1, longest + 1), ["s", "n", "l", "bundle", "tokens", "about"]
        for batch in batches:
            for i in range(batch.num_rows):
                s, n, tokens, df = (batch.column(k)[i].as_py() for k in range(4))
                n, tokens = np.frombuffer(n, dtype="<i8"), np.frombuffer(tokens, dtype="<u8")
                _, at = np.unique(_asked(tokens, groups), return_inverse=True)
                df = np.concatenate([_numbers(x["df"]) for x in sorted(df, key=lambda x: x["group"])])[at].astype(np.int64)
                size = _length(n, percent, longest)
                own = np.repeat(np.arange(len(n)), size)
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                level = np.maximum(1, pos - (n - need(n, percent))[own] + 1)
                more = df > 1
                own, tokens, df, level = own[more], tokens[more], df[more], level[more]
                if not len(own):
                    continue
                # The cost of l: postings read, and a candidate for every l of them at most.
                read = np.cumsum(np.bincount(own * longest + level - 1, weights=df, minlength=len(n) * longest).reshape(-1, longest), axis=1)
                ell = np.minimum(np.argmin(read * (1 + VERIFY / levels * n[:, None]), axis=1) + 1, np.maximum(1, need(n, percent)))
                first = np.flatnonzero(np.r_[True, np.diff(own) != 0])
                bundle, row = np.minimum.reduceat(tokens.view(np.int64), first), own[first]
                offsets = pa.array(np.r_[first, len(own)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (tokens.view(np.int64), df * 256 + level)]
                yield pa.RecordBatch.from_arrays([pa.array([s[16 * r : 16 * r + 16] for r in row], pa.binary()), pa.array(n[row]), pa.array(ell[row].astype(np.int32)), pa.array(bundle), *lists], names=names)
        tidy()

    picked = cut(told.mapInArrow(kept, "s binary, n long, l int, bundle long, tokens array<long>, about array<long>").dropDuplicates(["s"]))
    remove(spark, place)
    released(spark)
    # Documents that share tokens get neighbouring numbers, so that candidates are in few blocks.
    return dense_index(picked, "bundle", "s").drop("bundle")


def _wanted(posted: DataFrame, percent: int, block: int) -> DataFrame:
    """(bp, w) for each pair of blocks that holds candidates: w has documents r and their partners o."""
    each = posted.select("idx", "n", "l", F.explode(F.arrays_zip("tokens", "about")).alias("t"))
    posts = each.select(F.col("t.tokens").alias("token"), F.shiftright("t.about", 8).alias("df"), "idx", "n", F.col("t.about").bitwiseAND(F.lit(255)).cast("int").alias("level"), "l")
    part = F.pmod(F.xxhash64("idx"), F.ceil(F.col("df") / CHUNK)).cast("int")
    chunks = cut(posts.withColumn("part", part).groupBy("token", "part").agg(F.collect_list(F.struct("n", "idx", "level", "l")).alias("x"), F.first("df").alias("df")))
    fields = lambda x, p="": [F.col(f"{x}.{c}").alias(p + c) for c in ("n", "idx", "level", "l")]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _probe(batch, percent)

    alone = chunks.where((F.col("df") <= CHUNK) & (F.size("x") > 1)).select(*fields("x"), *fields("x", "o_")[:3])
    # each chunk of a crowded list goes to each of the list's chunks, and one task has one of them and all that come to it
    crowded = cut(chunks.where(F.col("df") > CHUNK).select("token", "part", "df", "x"))
    sent = crowded.select("token", F.explode(F.sequence(F.lit(0), F.ceil(F.col("df") / CHUNK).cast("int") - 1)).alias("part"), "x")
    met = sent.join(crowded.select("token", "part", F.col("x").alias("y")), ["token", "part"]).select(*fields("x"), *fields("y", "o_")[:3])
    found = alone.union(met).mapInArrow(probed, "r long, l int, other array<long>")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates: partners on at least l tokens; one row for each block that holds some."""
        names = ["rb", "ob", "r", "o"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                r, ell = part.column(0).to_numpy(), part.column(1).to_numpy()
                lists = part.column(2).flatten()
                per_row = np.add.reduceat(np.append(lists.value_lengths().to_numpy(zero_copy_only=False), 0), np.cumsum(np.r_[0, part.column(2).value_lengths().to_numpy(zero_copy_only=False)])[:-1]) if part.num_rows else np.zeros(0, np.int64)
                other = lists.flatten().to_numpy()
                row = np.repeat(np.arange(len(r)), per_row)
                order = np.lexsort((other, row))
                row, other = row[order], other[order]
                first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(other) != 0)]) if len(row) else np.zeros(0, np.int64)
                n = np.diff(np.r_[first, len(row)])
                row, other = row[first], other[first]
                enough = n >= ell[row]
                row, other = row[enough], other[enough]
                start = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(other // block) != 0)]) if len(row) else np.zeros(0, np.int64)
                offsets = pa.array(np.r_[start, len(row)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(r[row[start]] // block), pa.array(other[start] // block), pa.array(r[row[start]]), pa.ListArray.from_arrays(offsets, pa.array(other))], names=names)

    gathered = found.groupBy("r").agg(F.first("l").alias("l"), F.collect_list("other").alias("other")).mapInArrow(counted, "rb long, ob long, r long, o array<long>")
    # a checkpointed row keeps its number
    return cut(gathered.groupBy("rb", "ob").agg(F.collect_list(F.struct("r", "o")).alias("w"))).select(F.monotonically_increasing_id().alias("bp"), "w")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, n_shingles, component_id, set_id) for every row; how: words, percent, longest, block."""
    labelled = cut(_labelled(docs, row_key(F.col(id_col).cast("long"), F.col(text_col).cast("string")), id_col, text_col, **how).select("id", "s", "n", "c"))
    names = labelled.groupBy("c").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    return join_groups(labelled, names, "c", "rows").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.col("s").alias("set_id"))


def _labelled(docs: DataFrame, key: Column, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """(id, key, s, n, c) for every row: rows of one component have one c. key: a hash of the row that holds its text; rows
    are told by it, as their ids may be null or repeated."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), key.alias("key"))
    member, counts = _sets(texts, words, BUCKETS)
    posted = _posted(texts, counts, words, percent, longest)
    numbered = cut(posted.select("s", "l", "idx"))
    wanted = _wanted(posted, percent, block)
    del posted
    released(spark)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.unique(np.r_[w.values.field("r").to_numpy(), w.values.field("o").flatten().to_numpy()]) for w in batch.column(1)]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in ids])), pa.array(np.concatenate(ids), pa.int64())], names=["bp", "idx"])

    needs = cut(wanted.mapInArrow(touched, "bp long, idx long"))
    used = numbered.join(needs.select("idx").distinct(), "idx").select("s", "idx")
    one = cut(member.groupBy("s").agg(F.min("key").alias("key")).join(used, "s"))
    bearers = one.count()
    keys = small(one.select("key"), bearers, 16)

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            got = [shingle(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in got], pa.binary()), pa.array([x.tobytes() for x in got], pa.binary())], names=["s", "t"])
        tidy()

    read = texts.join(keys, "key", "left_semi").select("key", "text")
    if member.join(keys, "key", "left_semi").count() > bearers:
        read = read.dropDuplicates(["key"])  # repeated rows are read once
    read = read.select("text").mapInArrow(whole_sets, "s binary, t binary")
    # only the sets that a pair of blocks needs travel to it
    stored = read.join(small(one.select("s", "idx"), bearers, 24), "s").select("idx", "t")
    shipped = stored.join(small(needs, needs.count(), 16), "idx").groupBy("bp").agg(F.collect_list(F.struct("idx", "t")).alias("x"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, sets_ = (batch.column(k)[i].as_py() for k in range(2))
                got = {x["idx"]: np.frombuffer(x["t"], dtype=np.uint64) for x in sets_}
                root: dict[int, int] = {}

                def top(x: int, root: dict = root) -> int:
                    while root.get(x, x) != x:
                        root[x] = x = root.get(root[x], root[x])
                    return x

                links = []
                for x in w:
                    for o in x["o"]:
                        a, b = top(x["r"]), top(o)
                        # two documents that links join already need no further link
                        if a != b and linked(got[x["r"]], got[o], percent):
                            root[max(a, b)] = min(a, b)
                            links.append((x["r"], o))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    checked = wanted.join(shipped, "bp").select("w", "x").mapInArrow(verified, "a long, b long")
    joined = components(checked).join(numbered.select("s", F.col("idx").alias("node")), "node").select("s", "component")
    grouped = member.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).join(joined, "s")
    c = F.when(F.col("n") == 0, F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))).when(F.col("component").isNotNull(), F.concat(F.lit("="), F.col("component").cast("string")))
    return join_groups(member, grouped, "s", "rows", "left").withColumn("c", F.coalesce(c, F.hex("s")))


def _probe(batch: pa.RecordBatch, percent: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """For each probe of one chunk its partners in another, over all rows of a batch: smaller ones, or as large with a
    smaller number, alike enough in size, and on levels within the probe's l. At most about `most` pairs are held at a time."""
    first, second = batch.column(0), batch.column(4)
    at_a, at_b = (np.r_[0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64) for x in (first, second))
    n, idx, level, ell = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in range(4))
    n2, idx2, level2 = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (4, 5, 6))
    least = need(n, percent)
    sizes = np.diff(at_a) * np.diff(at_b)
    done = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        stop = max(row + 1, int(np.searchsorted(done, (done[row - 1] if row else 0) + most, "right")))
        size, width = sizes[row:stop], np.diff(at_b)[row:stop]
        own = np.repeat(np.arange(row, stop), size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(width, size)
        i, j = at_a[own] + within // wide, at_b[own] + within % wide
        ok = (level[i] <= ell[i]) & (level2[j] <= ell[i]) & (n2[j] <= n[i]) & (n2[j] >= least[i]) & ((n2[j] < n[i]) | (idx2[j] < idx[i]))
        i, j = i[ok], j[ok]
        start = np.flatnonzero(np.r_[True, np.diff(i) != 0]) if len(i) else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[start, len(i)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(idx[i[start]]), pa.array(ell[i[start]].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(idx2[j]))], names=["r", "l", "other"])
        row = stop


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with exactly one row of each component: that of the smallest id (nulls last), set and row hash, and one of the rows
    that are the same in all columns. Rows without shingles are similar to none and all stay."""
    key, name = row_key(*[F.col(f"`{c}`") for c in docs.columns]), fresh("key", docs)
    got = cut(_labelled(docs, key, id_col, text_col, **how).where("n > 0").select("c", "id", "s", "key"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "s", "key")
    first = cut(got.groupBy("c").agg(F.min(order)["key"].alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    shared = cut(join_groups(got, first, "c", "rows").groupBy("key", "first").agg(F.count(F.lit(1)).alias("rows")))
    keyed = docs.withColumn(name, key)
    gone = cut(shared.where("key <> first").select(F.col("key").alias(name)).distinct())
    out = keyed.join(small(gone, gone.count(), 16), name, "left_anti")
    again = cut(shared.where("key = first and rows > 1").select(F.col("key").alias(name)))
    n = again.count()
    if n:
        one = keyed.join(small(again, n, 16), name, "left_semi").dropDuplicates([name])
        out = out.join(small(again, n, 16), name, "left_anti").select(*keyed.columns).union(one.select(*keyed.columns))
    return out.drop(name)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP3_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') END AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {WORDS} + 2), lambda i: array_to_string(ws[i:i + {WORDS} - 1], ' ')) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
