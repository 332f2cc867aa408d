"""The registered queries on small tables of their own: the contracts' columns, held against plain loops."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ann, mixing, packing, personal_data, quality, registry

from .test_texts import base_spans, bootstrapped, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(21)
    rows = corpus()
    rows += [(900 + i, f"call +1 (017) 555-77{i:02d} or write to a{i}@mail.example.com, 10.0.{i}.7; token = \"{rng.getrandbits(160):040x}\" end", "web") for i in range(25)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    x = np.random.default_rng(22).standard_normal((260, 16)).astype(np.float32)
    spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, rows, x


def test_op1(spark, folder):
    at, _, x = folder
    got = ann.op1_ann(spark, at)
    assert [f.dataType.simpleString() for f in got.select("query_id", "rank", "vec_id", "score").schema] == ["bigint", "int", "bigint", "double"]
    found, hit = {}, 0
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    s = x.astype(float) @ x.astype(float).T
    assert set(found) == set(range(0, 260, 20))
    for q, rows in found.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21)) and all(math.isclose(v, s[q, i], rel_tol=1e-12, abs_tol=1e-12) for _, i, v in rows)
        due = sorted((i for i in range(260) if i != q), key=lambda i: (-s[q, i], i))[:20]
        hit += len({i for _, i, _ in rows} & set(due))
    assert hit >= 0.9 * 20 * 13


def test_op5(spark, folder):
    at, rows, _ = folder
    got = mixing.op5_mixing(spark, at).collect()
    size = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    own, names = Counter(), {i: s for i, _, s in rows}
    for _, t, s in rows:
        own[s] += size(t)
    weight = dict(zip([*sorted(s for s in own if s), None], (5, 2, 1), strict=True))  # three sources
    total, full = sum(own.values()), set()
    while True:
        level = (total - sum(3 * own[s] for s in full)) / sum(weight[s] for s in weight if s not in full)
        above = {s for s in weight if s not in full and weight[s] * level > 3 * own[s]}
        if not above:
            break
        full |= above
    taken = Counter()
    for r in got:
        s = names[r["doc_id"]]
        assert r["source_size"] == own[s] and abs(r["target"] - (3 * own[s] if s in full else weight[s] * level)) < 1e-6 * total
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in weight:
        due = 3 * own[s] if s in full else weight[s] * level
        assert abs(taken[s] - due) <= max(5, 0.01 * due)
    assert sorted(tuple(r) for r in mixing.op5_mixing(spark, at).collect()) == sorted(tuple(r) for r in got)


def test_op7(spark, folder):
    at, rows, _ = folder
    got = quality.op7_quality(spark, at)
    assert got.columns[:1] == ["doc_id"] and {"score", "keep"} <= set(got.columns)
    out = got.collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["keep"] == (r["score"] >= quality.THRESHOLD) for r in out)


def test_op9(spark, folder):
    from tokenizers import Tokenizer

    at, rows, _ = folder
    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    got = packing.op9_packing(spark, at).collect()
    want = Counter()
    for i, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((i, k, b, len(ids[b : b + 2048]), zlib.crc32(ids[b : b + 2048].tobytes())) for k, b in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(places) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_op10(spark, folder):
    at, rows, _ = folder
    got = {}
    for r in personal_data.op10_personal_data(spark, at).collect():
        got.setdefault(r["doc_id"], []).append(r)
    texts = sorted({t or "" for _, t, _ in rows})
    counted = Counter(t or "" for _, t, _ in rows)
    added = dict(zip(texts, bootstrapped([t for t in texts]), strict=True)) if max(counted.values()) == 1 else None
    order = ["email", "ip", "card", "phone", "secret"]
    for i, text, _ in rows:
        base = base_spans(text)
        r = next(r for r in got[i] if r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest())
        n = Counter(x.split(":")[0] for x in base)
        assert [r[f"n_{k}"] for k in order[:4]] == [n[k] for k in order[:4]]
        spans = r["spans"].split(",") if r["spans"] else []
        key = lambda x: (order.index(x.split(":")[0]), int(x.split(":")[1]))
        assert set(base) <= set(spans) and spans == sorted(spans, key=key) and r["n_added"] == len(spans) - len(base)
        if added is not None:
            assert spans == sorted([*base, *(x for x in added[text or ""].split(",") if x)], key=key)
        if i >= 900:
            assert sum(x.startswith("secret:") for x in spans) == 1


def test_registered_columns(spark, folder):
    assert list(registry.QUERIES) == [k for k in registry.QUERIES if k.startswith("op")] and len(registry.QUERIES) == 10


def test_label_model_against_loops():
    """Expectation-maximisation and the posterior by plain loops over documents instead of joint votes."""
    rng = random.Random(23)
    votes = []
    for _ in range(300):
        good = rng.random() < 0.8
        votes.append(tuple(rng.choice([quality.NONE, quality.GOOD if (rng.random() < 0.9) == good else quality.BAD]) for _ in range(4)))
    prior, table = 0.8, [[[0.3, 0.3, 0.4], [0.02, 0.6, 0.38]] for _ in range(4)]

    def posterior(v):
        p = [1 - prior, prior]
        for k, x in enumerate(v):
            p = [p[c] * table[k][c][x] for c in (0, 1)]
        return p[1] / sum(p)

    for _ in range(200):
        post = [posterior(v) for v in votes]
        table = [[[(sum((p if c else 1 - p) for p, v in zip(post, votes, strict=True) if v[k] == x) + 1) / (sum(p if c else 1 - p for p in post) + 3) for x in (0, 1, 2)] for c in (0, 1)] for k in range(4)]
        prior = min(0.99, max(0.01, (sum(post) + 1) / (len(votes) + 2)))
    count = Counter(votes)
    pattern = np.array(list(count))
    model = quality.fit_labels(pattern, np.array([float(count[v]) for v in count]))
    assert abs(model.prior - prior) < 1e-4 and np.allclose(model.table, table, atol=1e-4)
    assert np.allclose(model.posterior(pattern), [posterior(v) for v in count], atol=1e-4)


def test_scorer_against_loops():
    """The hashed scorer's loss can't be lowered in any direction: its gradient, by loops, is small."""
    rng = random.Random(24)
    texts = [" ".join(rng.choice(["good", "fine", "text"] if k % 3 else ["spam", "junk", "text"]) for _ in range(20)) for k in range(60)]
    soft = [0.9 if k % 3 else 0.1 for k in range(60)]
    rows = [(*(a.tobytes() for a in quality._sparse(t, 64, {})), p) for t, p in zip(texts, soft, strict=True)]
    weights, bias = quality.fit_scorer(rows, 64, passes=4000)
    share = sum(soft) / len(soft)
    gradient, at_bias = [1e-4 * w for w in weights], 0.0
    for t, p in zip(texts, soft, strict=True):
        words = t.split()
        buckets = [b for w in words for b in quality.features(w, 64)] + [zlib.crc32(b"t") % 64 for a, b in zip(words, words[1:], strict=False) if a == b]
        value = Counter(buckets)
        score = bias + sum(weights[b] * n / len(words) for b, n in value.items())
        off = (1 / (1 + math.exp(-score)) - p) * (p * 0.5 / share + (1 - p) * 0.5 / (1 - share)) / len(texts)
        at_bias += off
        for b, n in value.items():
            gradient[b] += off * n / len(words)
    assert max(map(abs, gradient)) < 2e-3 and abs(at_bias) < 2e-3
