"""Operator 7: quality classifier from weak labels.

Overlapping heuristics vote on every document: good, bad, or nothing. The counts of their joint votes (at most
3^labellers of them, whatever the corpus) go to the driver, where expectation-maximisation of a latent class model
estimates how often each labeller votes what on good and on bad documents, and so the probability of good for each joint
vote. These posteriors train a logistic scorer on hashed word features, on a bounded sample (SAMPLE documents at most, those of the
smallest hashes of id and text); the scorer then scores every whole document.

Defined results: null and empty texts hold no words; every labeller abstains on them, and the scorer, which finds no
evidence against them, keeps them with the prior's score; ids may be null or repeated, rows are judged on their own;
an empty table gives an empty result; more columns pass through, but for one with the name of the score, which is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, table, tidy

GOOD, BAD, NONE = 1, 0, 2
#: Documents that the scorer is fitted on, at most; buckets of its hashed features; passes over the sample.
SAMPLE, BUCKETS, PASSES = 4_000, 1 << 14, 200
#: Weight of the prior in a document's score, in words: little text is little evidence.
PRIOR_WORDS = 3
#: Score below which a document is rejected.
THRESHOLD = 0.5
#: Words whose features a task remembers.
REMEMBERED = 100_000

_SYMBOLS, _BLANKS, _UPPER = b"#$%&*|~^=<>{}[]\\_@+/", bytes([*range(9, 14), 32]), bytes(range(65, 91))
_NO_LETTERS = bytes(x for x in range(128) if not chr(x).isalpha())


def _bad(when: bool) -> int:
    """A vote of a labeller that knows one fault: that a document lacks this fault doesn't make it good."""
    return BAD if when else NONE


def votes(text: str) -> tuple[int, ...]:
    """One vote for each labeller."""
    words = text.split()
    n = len(words)
    if not n:
        return (NONE,) * len(LABELLERS)
    raw = text.encode()
    count = lambda some: len(raw) - len(raw.translate(None, some))
    chars = len(text) - count(_BLANKS)
    letters = len(text) - count(_NO_LETTERS)  # beyond ASCII, all count as letters
    upper = count(_UPPER) / max(1, letters)
    twins = sum(map(eq, words, words[1:])) / n
    kinds = len(set(words))
    signs = count(_SYMBOLS) / len(text)
    odd = 1 - letters / max(1, chars)
    stops = count(b".,;:?") / n
    several = n >= 5
    return (
        _bad(signs > 0.08),
        _bad(several and words.count("|") / n > 0.1),
        _bad(several and letters >= 15 and upper > 0.5),
        _bad(several and twins > 0.2),
        _bad(several and text.count("!") / n > 0.3),
        BAD if kinds < 0.5 * n**0.75 else GOOD if kinds >= n**0.75 else NONE,
        _bad(odd > 0.25),
        _bad(chars / n > 15),
        GOOD if (n < 12 or 0.03 <= stops <= 0.4) and upper < 0.35 and signs < 0.02 and twins < 0.05 else NONE,
    )


LABELLERS = ("symbols", "pipes", "capitals", "twins", "shouting", "variety", "letters", "length", "prose")
#: Where estimation starts: P(bad, good, no vote) on bad and on good documents. A fault's labeller is seldom wrong.
START = ((0.3, 0.3, 0.4), (0.02, 0.6, 0.38))


@dataclass
class LabelModel:
    """P(good) and, for each labeller, P(vote | class): table[labeller, class, vote], no vote being a vote too."""

    prior: float
    table: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes."""
        k = np.arange(pattern.shape[1])
        logs = np.log(self.table)
        bad, good = (logs[k, c, pattern].sum(1) for c in (0, 1))
        return 1 / (1 + np.exp(np.clip(bad - good + np.log(1 - self.prior) - np.log(self.prior), -500, 500)))


def fit_labels(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation from the counts of joint votes. Labellers start as fairly right, so classes can't swap."""
    model = LabelModel(0.8, np.tile(np.array(START), (pattern.shape[1], 1, 1)))
    for _ in range(rounds):
        good = model.posterior(pattern) * count
        both = np.stack([count - good, good])
        new = np.empty_like(model.table)
        for k in range(pattern.shape[1]):
            for c in (0, 1):
                held = np.array([both[c][pattern[:, k] == v].sum() for v in (BAD, GOOD, NONE)]) + 1.0
                new[k, c] = held / held.sum()
        moved = abs(new - model.table).max()
        model = LabelModel(float(np.clip((good.sum() + 1) / (count.sum() + 2), 0.01, 0.99)), new)
        if moved < 1e-7:
            break
    return model


_CLASSES = str.maketrans({**{chr(x): "a" for x in range(97, 123)}, **{chr(x): "A" for x in range(65, 91)}, **{chr(x): "9" for x in range(48, 58)}})


def features(word: str, buckets: int) -> tuple[int, ...]:
    """Buckets of a word: itself, its shape (kinds of its first and last characters) and its last characters."""
    shape = (word[:1] + word[-3:]).translate(_CLASSES)
    return zlib.crc32(("w" + word).encode()) % buckets, zlib.crc32(("s" + shape).encode()) % buckets, zlib.crc32(("e" + word[-2:]).encode()) % buckets


class Scores(dict):
    """Summed weights of words, filled as they are asked for; the weights of shapes and ends are few and kept."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.ends, self.buckets = weights.tolist(), {}, len(weights)

    def __missing__(self, word: str) -> float:
        end = word[:1] + word[-3:]
        rest = self.ends.get(end)
        if rest is None:
            _, s, e = features(word, self.buckets)
            rest = self.ends[end] = self.weights[s] + self.weights[e]
        out = rest + self.weights[zlib.crc32(("w" + word).encode()) % self.buckets]
        if len(self) < REMEMBERED:
            self[word] = out
        return out


TWIN = "t"


def _sparse(text: str, buckets: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    if len(known) > REMEMBERED:
        known.clear()
    flat: list[int] = []
    for w in words:
        f = known.get(w)
        if f is None:
            f = known[w] = features(w, buckets)
        flat += f
    flat += [zlib.crc32(TWIN.encode()) % buckets] * sum(map(eq, words, words[1:]))
    at, n = np.unique(np.array(flat, dtype=np.int64), return_counts=True)
    return at.astype("<i4"), (n / max(1, len(words))).astype("<f4")


def fit_scorer(rows: list[tuple[bytes, bytes, float]], buckets: int, passes: int = PASSES, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression to soft labels (Adam). Both classes weigh alike; the decay keeps words from being learnt by heart."""
    weights, bias = np.zeros(buckets), 0.0
    if not rows:
        return weights, bias
    at = [np.frombuffer(a, "<i4") for a, _, _ in rows]
    index, row = np.concatenate(at), np.repeat(np.arange(len(rows)), [len(a) for a in at])
    value = np.concatenate([np.frombuffer(v, "<f4") for _, v, _ in rows]).astype(float)
    soft = np.array([p for _, _, p in rows])
    share = np.clip(soft.mean(), 0.02, 0.98)
    importance = soft * 0.5 / share + (1 - soft) * 0.5 / (1 - share)
    m, v = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for t in range(1, passes + 1):
        score = np.bincount(row, value * weights[index], len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - soft) * importance / len(rows)
        grad = np.append(np.bincount(index, value * off[row], buckets) + decay * weights, off.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, float(bias)


def _batches(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, buckets: int = BUCKETS, score_col: str = "score") -> DataFrame:
    """docs with the scorer's probability of good in score_col, the last column."""
    ship(docs.sparkSession)
    n_votes = len(LABELLERS)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != score_col.lower()])
    text = F.col(text_col).cast("string")
    texts = docs.select(text.alias("text"))

    def joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for whole in batches:
            for text in whole.column(0):
                code = 0
                for v in votes(text.as_py() or ""):
                    code = code * 3 + v
                seen[code] = seen.get(code, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"])
        tidy()

    # at most 3^9 rows
    counted = texts.mapInArrow(joint, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    codes, count = np.array([r[0] for r in counted], dtype=np.int64), np.array([r[1] for r in counted], dtype=float)
    pattern = np.stack([(codes // 3**k) % 3 for k in range(n_votes - 1, -1, -1)], 1) if len(codes) else np.zeros((0, n_votes), dtype=np.int64)
    model = fit_labels(pattern, count) if len(codes) else LabelModel(0.8, np.full((n_votes, 2, 3), 1 / 3))
    believed = dict(zip(codes.tolist(), model.posterior(pattern).tolist(), strict=True)) if len(codes) else {}

    def weak(text: str) -> float:
        code = 0
        for v in votes(text):
            code = code * 3 + v
        return believed.get(code, model.prior)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for whole in batches:
            for batch in _batches(whole):
                rows = [(*_sparse(t, buckets, known), weak(t)) for t in (x.as_py() or "" for x in batch.column(0))]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a.tobytes() for a, _, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v, _ in rows], pa.binary()), pa.array([p for _, _, p in rows], pa.float64())], names=["h", "a", "v", "p"])
        tidy()

    total = int(count.sum())
    # Hashes below a bound that lets somewhat more than the sample through, and of these the smallest. Where rows repeat so much
    # that none is below it, the bound grows; the sample's size never does.
    hashed, share = docs.select(text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text, F.lit(7)).alias("h")), min(1.0, 1.2 * sample / max(1, total))
    fitted: list = []
    while total and not fitted:
        below = hashed.where(F.col("h") <= F.lit(int(-(2**63) + share * (2**64 - 1024)))) if share < 1 else hashed
        fitted = below.mapInArrow(sampled, "h long, a binary, v binary, p double").orderBy("h", "p", "a", "v").limit(sample).collect()
        if share >= 1:
            break
        share = min(1.0, share * 64)
    weights, bias = fit_scorer([tuple(map(bytes, r[1:3])) + (r[3],) for r in fitted], buckets)

    names = docs.columns
    # the closure holds BUCKETS weights: its size doesn't depend on the corpus
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(weights)
        twin = known.weights[zlib.crc32(TWIN.encode()) % buckets]
        prior = PRIOR_WORDS * log(model.prior / (1 - model.prior))
        for whole in batches:
            for batch in _batches(whole):
                out = []
                for x in batch.column(batch.num_columns - 1):
                    words = (x.as_py() or "").split()
                    s = len(words) * bias + sum(map(known.__getitem__, words)) + twin * sum(map(eq, words, words[1:]))
                    out.append(1 / (1 + exp(-min(50.0, max(-50.0, (prior + s) / (PRIOR_WORDS + len(words)))))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*names, score_col])
        tidy()

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.withColumn(fresh("__text", docs), text).mapInArrow(scored, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = classify(docs)
    return got.select("doc_id", "score", (F.col("score") >= THRESHOLD).alias("keep"))
