"""Operator 9: best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids; only documents above the sequence length are cut. Pieces of full length are sequences of
their own. The others are dealt at random over shards of a bounded number of pieces. For each shard some islands breed
packings of its pieces, founded by best fit in random orders: crossover puts whole well-filled bins of one parent into the
other, removes the bins that now hold a piece twice, dissolves some of the emptiest, and best-fits the displaced pieces,
longest first. After each epoch an island's elite migrates to the next island of the shard, through a shuffle; at the end the
packing with the fewest bins stays. Shards whose best packing is as small as the sum of lengths allows breed no further.

Defined results: null and empty texts count as empty and make a piece of the end token alone; ids may be null or repeated,
each row is packed on its own; an empty table gives an empty result; more columns pass by.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tidy

LENGTH, END = 2048, 0
#: Pieces of a shard, about; islands of a shard; epochs; packings on an island; children an epoch.
SHARD, ISLANDS, EPOCHS, PACKINGS, CHILDREN = 8192, 4, 4, 2, 3
#: Pieces and words whose ids a worker remembers, in each of two generations.
PIECES_KEPT, WORDS_KEPT = 500_000, 50_000
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already has a process for each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The tokenizer's own rule of pieces for texts of Latin-1 characters: contractions, letters, single numbers, other runs.
_LATIN = [chr(x) for x in range(256)]
_LETTER = "".join(c for c in _LATIN if c.isalpha())
_NUMBER = "".join(c for c in _LATIN if c.isnumeric() and not c.isalpha())
_WHITE = "\x09-\x0d\x20\x85\xa0"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_WHITE}{_LETTER}{_NUMBER}]+")
#: The characters that stand for bytes in a byte-level vocabulary (fixed values): printable ones for themselves, the others from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {x: chr(x) for x in _SELF} | {x: chr(256 + k) for k, x in enumerate(y for y in range(256) if y not in _SELF)}


class Ids(dict):
    """The ids of pieces or words as bytes, found by `learn` when they are asked for first.

    Bounded: of two generations of `size` entries, the old one is forgotten when the young one is full.
    """

    def __init__(self, learn, size: int):
        super().__init__()
        self.learn, self.size, self.old = learn, size, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.learn(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Token ids of whole texts, by the tokenizer's model piece by piece, as pieces repeat.

    The tokenizer makes small letters, cuts a text into pieces by its rule and encodes each piece alone. A text of Latin-1
    characters, where small letters and the composed form depend on one character only, is cut here by the same rule, and the
    tokenizer's model gets only pieces that are not remembered. Other texts, and texts with what may be a special token, are cut
    at white space, which the tokenizer drops and never joins words across, and whole words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.pieces, self.words = Ids(self._piece, PIECES_KEPT), Ids(self._word, WORDS_KEPT)

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        small = text.isascii()
        if not small:
            try:
                text.encode("latin-1")
                small = True
            except UnicodeEncodeError:
                pass
        if small and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, filter(None, _BLANK.split(text))))


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, which keeps what it learned from task to task."""
    return Encoder(path)


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each document."""

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer_path), np.uint32(end).astype("<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(text.as_py() or "") + last
                    for k, b in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[b : b + 4 * length]
                        out.append((doc, k, b // 4, len(part) // 4, zlib.crc32(part)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["id", "piece", "start", "length", "ids_crc32"])
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tokenized, PIECES)


#: A bin: its free room and its pieces. A packing: its bins.
Bin = tuple[int, list[int]]


def best_fit(lens: list[int], order: list[int], size: int, kept: list[Bin] = ()) -> list[Bin]:
    """The kept bins and, best-fitted into them and new ones, the pieces in the given order.

    Best fit finds the least room that is enough in a bit set of the rooms that occur.
    """
    items, by_room, mask = [], [[] for _ in range(size + 1)], 0
    for room, held in kept:
        by_room[room].append(len(items))
        mask |= 1 << room
        items.append(held.copy())
    for i in order:
        need = lens[i]
        above = mask >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            at = by_room[room]
            k = at.pop()
            if not at:
                mask ^= 1 << room
            items[k].append(i)
        else:
            room, k = size, len(items)
            items.append([i])
        room -= need
        by_room[room].append(k)
        mask |= 1 << room
    return [(room, items[k]) for room, held in enumerate(by_room) for k in held]


def worth(packing: list[Bin], size: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller full bins (Falkenauer's squared fill)."""
    return len(packing), -sum([(1 - room / size) ** 2 for room, _ in packing])


def cross(lens: list[int], one: list[Bin], two: list[Bin], size: int, rng: random.Random) -> list[Bin]:
    """Puts well-filled bins of two into one; bins of one that share a piece with them dissolve, as do its emptier ones.

    Bins of a packing stand in the order of their room.
    """
    good = two[: 1 + int(len(two) * rng.uniform(0.1, 0.6))]
    kept = rng.sample(good, 1 + int((len(good) - 1) * rng.uniform(0.3, 1)))
    new = {i for _, b in kept for i in b}
    # the emptier bins dissolve too, so that their pieces may close other bins
    most, loose = one[int((len(one) - 1) * rng.uniform(0.1, 1))][0], []
    for room, b in one:
        if room <= most and new.isdisjoint(b):
            kept.append((room, b))
        else:
            loose += [i for i in b if i not in new]
    loose.sort(key=lambda i: (-lens[i], i))
    return best_fit(lens, loose, size, kept)


def evolve(lens: list[int], packings: list[list[Bin]], size: int, children: int, most: int, rng: random.Random) -> list[list[Bin]]:
    """An epoch on one island: the packings that stay, the best first. Stops early at the lower bound."""
    bound = -(-sum(lens) // size)
    ranked = sorted(((worth(p, size), k, p) for k, p in enumerate(packings)), key=lambda x: x[:2])
    serial = len(ranked)
    for _ in range(children):
        if ranked[0][0][0] <= bound or len(ranked) < 2:
            break
        a, b = rng.sample(range(len(ranked)), 2)
        child = cross(lens, ranked[a][2], ranked[b][2], size, rng)
        score = worth(child, size)
        if all(score != x[0] for x in ranked):
            ranked = sorted([*ranked, (score, serial, child)], key=lambda x: x[:2])[:most]
            serial += 1
    return [p for _, _, p in ranked]


def first_packings(lens: list[int], size: int, n: int, rng: random.Random) -> list[list[Bin]]:
    """Best fit in n random orders."""
    return [best_fit(lens, rng.sample(range(len(lens)), len(lens)), size) for _ in range(n)]


def _flat(packing: list[Bin], n: int) -> bytes:
    bins = np.zeros(n, dtype="<i4")
    for k, (_, b) in enumerate(packing):
        bins[b] = k
    return bins.tobytes()


def _bins(flat: bytes, lens: np.ndarray, size: int) -> list[Bin]:
    own = np.frombuffer(flat, dtype="<i4")
    order = np.argsort(own, kind="stable")
    room = size - np.bincount(own, lens).astype(int)
    return list(zip(room.tolist(), (x.tolist() for x in np.split(order, np.flatnonzero(np.diff(own[order])) + 1)), strict=True))


STATE = "shard long, island int, pids binary, lens binary, packings array<binary>, bins int"


def _epoch(size: int, children: int, most: int, epoch: int):
    """One row an island: without packings it is founded, with the last one a migrant it goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = random.Random(f"{row['shard']} {row['island']} {epoch}")
                own = np.frombuffer(row["lens"], dtype="<i4")
                lens, old = own.tolist(), [_bins(p, own, size) for p in row["packings"]]
                packings = evolve(lens, old or first_packings(lens, size, most, rng), size, children, most, rng)
                flat = [_flat(p, len(lens)) for p in packings]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([row["pids"]], pa.binary()), pa.array([row["lens"]], pa.binary()), pa.array([flat], pa.list_(pa.binary())), pa.array([len(packings[0])], pa.int32())], names=["shard", "island", "pids", "lens", "packings", "bins"])

    return run


def pack(parts: DataFrame, length: int = LENGTH, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, packings: int = PACKINGS, children: int = CHILDREN) -> DataFrame:
    """parts with sequence_id and offset. parts needs a unique long pid and a long length of 1 to `length`."""
    short = parts.where(F.col("length") < length).select("pid", "length")
    n = short.count()
    shards = max(1, -(-n // shard))

    def founded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items = sorted((-x["length"], x["pid"]) for x in row["items"])
                pids, lens = np.array([p for _, p in items], dtype="<i8").tobytes(), np.array([-x for x, _ in items], dtype="<i4").tobytes()
                for i in range(islands):
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([i], pa.int32()), pa.array([pids], pa.binary()), pa.array([lens], pa.binary()), pa.array([[]], pa.list_(pa.binary())), pa.array([0], pa.int32())], names=["shard", "island", "pids", "lens", "packings", "bins"])

    dealt = short.withColumn("shard", F.pmod(F.xxhash64("pid"), F.lit(shards)))
    state = dealt.groupBy("shard").agg(F.collect_list(F.struct("pid", "length")).alias("items")).mapInArrow(founded, STATE)
    for epoch in range(epochs):
        state = cut(state.repartition("shard", "island").mapInArrow(_epoch(length, children, packings, epoch), STATE))
        if epoch + 1 < epochs:
            elite = state.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.col("packings")[0].alias("elite"))
            state = state.join(elite, ["shard", "island"]).select("shard", "island", "pids", "lens", F.concat("packings", F.array("elite")).alias("packings"), "bins")
    best = state.select("shard", F.struct("bins", "island", "pids", "lens", F.col("packings")[0].alias("packing")).alias("s")).groupBy("shard").agg(F.min("s").alias("s")).select("shard", "s.*")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, lens, pids = (np.frombuffer(row[k], dtype=t) for k, t in (("packing", "<i4"), ("lens", "<i4"), ("pids", "<i8")))
                order = np.argsort(own, kind="stable")
                before = np.cumsum(lens[order], dtype=np.int64) - lens[order]
                first = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
                offset = before - np.repeat(before[first], np.diff(np.r_[first, len(order)]))
                yield pa.RecordBatch.from_arrays([pa.array(pids[order]), pa.array((row["shard"] << 32) + own[order].astype(np.int64)), pa.array(offset)], names=["pid", "sequence_id", "offset"])

    spots = best.mapInArrow(placed, "pid long, sequence_id long, offset long")
    alone = F.col("length") >= length
    return parts.join(spots, "pid", "left").withColumn("sequence_id", F.when(alone, -1 - F.col("pid")).otherwise(F.col("sequence_id"))).withColumn("offset", F.when(alone, F.lit(0).cast("long")).otherwise(F.col("offset")))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    # The number of a checkpointed row stays the same whenever the row is read again.
    parts = cut(pieces(docs, tokenizer_path, id_col, text_col, length, end)).withColumn("pid", F.monotonically_increasing_id())
    return pack(parts, length).drop("pid")


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer()).withColumnRenamed("id", "doc_id")
