"""Line dedup, n-gram join, quality, mixing, packing, personal data, chats and pages against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex

from tessera.llm import chat, html_text, line_dedup, mixing, ngram_join, packing, personal_data, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, id string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "h", "x", 1) for i, t, s in rows], DOCS)


def words(rng, n, vocabulary=400):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


# line dedup


def test_line_dedup(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join([*([" Menu "] if i % 3 else []), " ".join(words(rng, 6)), "", *(["rare line"] if i < 3 else []), " ".join(words(rng, 5))]), f"s{i % 2}" if i % 11 else None) for i in range(200)]
    rows += [(200, None, "s0"), (201, "", "s0"), (202, "Menu", "s1"), (202, "Menu", "s1"), (203, "\n\n", None)]
    got = line_dedup.drop_boilerplate(frame(spark, rows), max_ratio=0.1, min_pages=3, lines_col="n_lines", dropped_col="n_dropped")
    assert got.columns[:8] == [c.split()[0] for c in DOCS.split(", ")]
    pages = Counter(s for _, _, s in rows)
    seen = Counter((s, x.strip()) for _, t, s in rows for x in {y.strip() for y in (t or "").split("\n")} if x.strip())
    want = Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if not x.strip() or seen[s, x.strip()] < 3 or seen[s, x.strip()] <= 0.1 * pages[s])) for i, t, s in rows)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert sum(r["n_dropped"] for r in got.collect()) > 100
    con = duckdb.connect()
    documents = frame(spark, rows).select("doc_id", "text", "source").toPandas()  # noqa: F841
    sql = con.sql(line_dedup.OP2_SQL).fetchall()
    ours = line_dedup.drop_boilerplate(frame(spark, rows).select("doc_id", "source", "text"), lines_col="n_lines", dropped_col="n_dropped").select("doc_id", "source", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, ours)) == Counter(sql)
    assert line_dedup.drop_boilerplate(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_shuffled(spark, monkeypatch):
    rows = [(i, "Menu\nown " + str(i), "s") for i in range(30)]
    one = line_dedup.drop_boilerplate(frame(spark, rows), max_ratio=0.1).collect()
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    two = line_dedup.drop_boilerplate(frame(spark, rows), max_ratio=0.1).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two)) and one[0]["text"].startswith("own")


# n-gram join


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n=3, percent=90):
    sets = [shingles(t, n) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and top(i) != top(j):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least[top(i)]) for i, r in enumerate(rows))


def corpus(seed=5):
    rng = random.Random(seed)
    passage = words(rng, 30)
    rows = []
    for i in range(120):
        w = words(rng, rng.choice([1, 2, 3, 10, 60, 200]))
        if i % 4 == 0:
            w += passage
        rows.append((i, " ".join(w), "s"))
    base = words(rng, 150)
    for i in range(120, 200):  # near copies, some more, some less alike
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        rows.append((i, " ".join(w), "s"))
    rows += [(300 + i, rows[125][1].upper() if i % 2 else rows[125][1].replace(" ", "\t\n"), "s") for i in range(40)]
    return rows + [(400, None, "s"), (401, "", "s"), (402, " \n", None), (403, "Hi", "s"), (404, "hi", "s"), (405, "a b", "s"), (406, "A  B", "s"), (407, " ".join(words(rng, 5000)), "s"), (300, rows[125][1], "s")]


def test_ngram_join(spark, monkeypatch):
    rows = corpus()
    got = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar(frame(spark, rows)).collect())
    assert got == brute(rows)
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    got = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar(frame(spark, rows), words=5, percent=80, block=4).collect())
    assert got == brute(rows, 5, 80)
    kept = {r["doc_id"] for r in ngram_join.one_of_each(frame(spark, rows)).collect()}
    assert kept == {c for _, _, c in brute(rows)}
    assert ngram_join.similar(frame(spark, rows).limit(0)).count() == 0


def test_ngram_join_null_ids(spark):
    rng = random.Random(12)
    base, other, third = (words(rng, 120) for _ in range(3))
    near = lambda w, k: " ".join([*w[:-1], f"end{k}"])
    rows = [(1, near(base, 1), "s"), (None, near(base, 2), "s"), (None, near(other, 1), "s"), (None, near(other, 2), "t")] + [(None, near(base, 3), "s")] * 5
    rows += [(7, near(third, 1), "s")] * 3 + [(7, near(third, 2), "s"), (None, None, "s"), (9, "something else", "s")]
    got = ngram_join.similar(frame(spark, rows)).collect()
    assert Counter((r["id"], r["component_id"]) for r in got) == Counter({(1, 1): 1, (None, 1): 6, (None, None): 3, (7, 7): 4, (9, 9): 1})
    # both sets of the second text are on rows without an id: one of its names serves as well as the other
    some = frame(spark, rows[2:4] + [(3, near(other, 3), "s")])
    assert {r["component_id"] for r in ngram_join.similar(some).collect()} == {3}


def test_one_of_each_keeps_one_row(spark):
    rng = random.Random(13)
    base, other, alone, third = (words(rng, 120) for _ in range(4))
    near = lambda w, k: " ".join([*w[:-1], f"end{k}"])
    copies = [(5, near(base, 1), "s")] * 3 + [(5, near(base, 1), "t"), (6, near(base, 2), "s")]
    nulls = [(None, near(other, 1), "s")] * 2 + [(None, near(other, 2), "s")]
    shared = [(1, near(third, 1), "s"), (8, near(third, 2), "s"), (8, " ".join(alone), "s")]
    empty = [(20, None, "s"), (20, None, "s"), (None, "", "s")]
    out = ngram_join.one_of_each(frame(spark, copies + nulls + shared + empty))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    lost = [x for x in got if x[0] is None and x[1]]
    assert len(lost) == 1 and got.pop(lost[0]) == 1 and lost[0][1] in (near(other, 1), near(other, 2))
    assert got == Counter({(5, near(base, 1)): 1, (1, near(third, 1)): 1, (8, " ".join(alone)): 1, (20, None): 2, (None, ""): 1})


# quality


def test_quality_labels():
    rng = random.Random(2)
    good = " ".join(w + "," if rng.random() < 0.1 else w for w in ["the", "quick", "fox", "jumps", "over", "lazy", "dogs", "and", "cats"] * 4)
    assert quality.BAD in quality.votes("BUY NOW!! " * 30) and quality.BAD not in quality.votes(good[:60])
    assert set(quality.votes("")) == {quality.NONE}
    pattern = np.array([[0, 2, 2], [2, 0, 0], [2, 2, 1], [2, 1, 1]])
    p = quality.fit_labels(pattern, np.array([20.0, 20.0, 400.0, 400.0])).posterior(pattern)
    assert (p[:2] < 0.5).all() and (p[2:] > 0.5).all()


def test_quality(spark):
    rng = random.Random(3)
    syllables = ["ba", "ke", "lo", "mi", "nu", "sta", "tri", "ven"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    clean = lambda n: ". ".join(" ".join(word() for _ in range(8)).capitalize() for _ in range(n)) + "."
    rows, bad = [], set()
    for i in range(400):
        text = clean(rng.randrange(2, 30))
        if i % 8 == 0:
            bad.add(i)
            text = [" | ".join(text.split()), text.upper().replace(" ", "!! "), " ".join(w + "%%%" for w in text.split()), " ".join([word()] * 40 + [word()] * 60)][i // 8 % 4]
        rows.append((i, text, "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "word", None), (502, "word", None)]
    got = quality.classify(frame(spark, rows), score_col="__score").collect()
    assert len(got) == len(rows)
    keep = {r["doc_id"] for r in got if r["__score"] >= quality.THRESHOLD}
    assert {500, 501} <= keep
    assert len(keep & bad) <= 0.06 * len(bad) + 1 and len(set(range(400)) - bad - keep) <= 4
    assert quality.classify(frame(spark, rows).limit(0)).count() == 0


# mixing


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, int(1 + 300 * rng.random() ** 3))), rng.choice(["a", "b", "é", None, "z"]) if i % 3 else "a") for i in range(900)]
    rows += [(2000 + i, "tiny words here", "tiny") for i in range(3)] + [(3000, None, "a"), (3001, "", "b"), (3002, "x", None), (3002, "x", None)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _, _ in rows)
    size, by = {i: len((t or "").split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    own = Counter()
    for i, t, s in rows:
        own[s] += len((t or "").split())
    order = sorted((s for s in own if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        level = (sum(own.values()) - sum(3 * own[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        new = {s for s in weight if s not in full and weight[s] * level > 3 * own[s]}
        if not new:
            break
        full |= new
    target = {s: 3 * own[s] if s in full else weight[s] * level for s in weight}
    taken = Counter()
    for r in got:
        s = by[r["id"]]
        assert r["size"] == size[r["id"]] and r["source_size"] == own[s] and 0 <= r["copies"] <= 3
        assert abs(r["target"] - target[s]) < 1e-6 * target[s]
        taken[s] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= max(5, 0.01 * target[s]) for s in target)
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert Counter((r["id"], r["copies"]) for r in again) == Counter((r["id"], r["copies"]) for r in got)
    out = mixing.mixed(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert Counter(r["doc_id"] for r in out.collect()) == +Counter({i: sum(r["copies"] for r in got if r["id"] == i) for i in size})
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0


def test_tilt_meets_targets(spark):
    size, count = [0, 1, 7, 50, 3000], [5, 40, 30, 10, 1]
    total = sum(a * b for a, b in zip(size, count, strict=True))
    shares = [0.0, 0.01, 0.5, 1.0, 1.7, 2.99, 3.0]
    cells = spark.createDataFrame([(f"s{k}", a, b) for k in range(len(shares)) for a, b in zip(size, count, strict=True)] + [("none", 0, 3)], "key string, size long, n long")
    wanted = spark.createDataFrame([(f"s{k}", total, x * total) for k, x in enumerate(shares)] + [("none", 0, 0.0)], "key string, source_size long, target double")
    got = {}
    for r in mixing.rates(cells, wanted, 3).collect():
        got.setdefault(r["key"], {})[r["size"]] = r["rate"]
    assert got.pop("none") == {0: 1.0}
    for k, x in enumerate(shares):
        rate = np.array([got[f"s{k}"][n] for n in size])
        assert rate[0] == 1.0 and abs((rate * size * count).sum() - x * total) < 1e-6 * total and (rate >= 0).all() and (rate <= 3).all()
        # the odds of a rate are exponential in the size
        some = (rate > 1e-9) & (rate < 3 - 1e-9) & (np.array(size) > 0)
        odds = np.log(rate[some] / (3 - rate[some]) * 2) / np.array(size)[some]
        assert np.allclose(odds, odds[0] if len(odds) else 0, rtol=1e-3, atol=1e-6)


def test_mixing_of_copies(spark, monkeypatch):
    """Rows that are all the same, without ids: some have a copy more than others, and none stands with others for its part."""
    monkeypatch.setattr(mixing, "CELL", 10)
    rows = [(None, "one two three", "a")] * 205 + [(i % 7, f"one two n{i % 50}", "a") for i in range(300)] + [(9, "b " * 40, "b")] * 31
    df = frame(spark, rows)
    got, out = mixing.mix(df).collect(), mixing.mixed(df).collect()
    assert len(got) == len(rows)
    own = {"=a": 505 * 3, "=b": 31 * 40}
    taken, again = Counter(), Counter()
    for r in got:
        taken[r["key"]] += r["copies"] * r["size"]
        assert r["source_size"] == own[r["key"]] and r["copies"] <= 3
    for r in out:
        again["=" + r["source"]] += len(r["text"].split())
    assert taken == again and Counter(r["id"] for r in got for _ in range(r["copies"])) == Counter(r["doc_id"] for r in out)
    assert abs(taken["=a"] - 5 / 7 * sum(own.values())) <= 3 and abs(taken["=b"] - 2 / 7 * sum(own.values())) <= 40


# packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.word_tokenizer())


def test_encoder(tokenizer):
    encode = packing.Encoder(packing.word_tokenizer())
    for text in ["The Cat's, hat. x..", "<|endoftext|> a<|startoftext|>, İ. Σας ΑΣ.", "", " ", "\x1c a\x85b c\n\n", "É. É ǅ, ﬁ. don't 12,3.", "a." * 300, "日本語, текст."]:
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_packing(spark, tokenizer):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, int(1500 * rng.random() ** 2))), "s") for i in range(150)] + [(500, None, "s"), (501, "", "s"), (502, "same", "s"), (502, "same", "s"), (503, " ".join(words(rng, 9000)), "s")]
    got = packing.pack_documents(frame(spark, rows), packing.word_tokenizer()).collect()
    by, bins = {}, {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want = Counter((k, b, len(ids[b : b + 2048]), zlib.crc32(ids[b : b + 2048].tobytes())) for k, b in enumerate(range(0, len(ids), 2048)))
        assert +Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]) == Counter({k: v * (2 if i == 502 else 1) for k, v in want.items()})
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r["length"] for r in got) // 2048)
    assert len(bins) <= least + 1
    assert packing.pack_documents(frame(spark, rows).limit(0), packing.word_tokenizer()).count() == 0


def test_encoder_on_odd_texts(tokenizer):
    rng, encode = random.Random(12), packing.Encoder(packing.word_tokenizer())
    encode.pieces.size = encode.words.size = 50  # forgets all the time
    parts = [*map(chr, range(1, 256)), "'s", "'T", "'re", "\u0130", "\u03a3", "\u03c2", "e\u0301", "<|endoftext|>", "<|", "\u4e2d", " ", "  ", "a", "b", "123", "\xb2", "\xba", "\xb5"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_genetic_packing():
    rng = random.Random(7)
    lens = [rng.randrange(500, 1100) for _ in range(300)]
    first = packing.first_packings(lens, 2048, 4, rng)
    last = packing.evolve(lens, first, 2048, 20, 4, rng)
    child = packing.cross(lens, first[0], first[2], 2048, rng)
    for p in [*first, *last, child]:
        assert sorted(i for _, b in p for i in b) == list(range(300)) and all(room == 2048 - sum(lens[i] for i in b) >= 0 for room, b in p)
    assert packing.worth(last[0], 2048) < min(packing.worth(p, 2048) for p in first)
    assert packing._bins(packing._flat(first[0], 300), np.array(lens), 2048) == [(room, sorted(b)) for room, b in first[0]]


def test_packing_beats_best_fit_decreasing(spark):
    """Triples that fill a sequence each: best fit decreasing, which pairs the longest pieces wrongly, needs more."""
    rng, lens = random.Random(13), []
    for _ in range(60):
        a = rng.randint(780, 1000)
        b = rng.randint(500, (2048 - a) // 2 - 1)
        lens += [a, b, 2048 - a - b]
    decreasing = packing.best_fit(lens, sorted(range(len(lens)), key=lambda i: -lens[i]), 2048)
    parts = spark.createDataFrame(list(enumerate(lens)), "pid long, length long")
    got = packing.pack(parts).collect()
    assert len(got) == len(lens)
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048
    assert 60 <= len(used) < len(decreasing)


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def test_personal_data(spark):
    rng = random.Random(8)
    parts = ["a@b.co", "x.y@c-d.e.f", "@", "a@b", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "001.002.03.255", "1.2.3.4.5.6.7.8", "4929348385146306", "4929 3483-8514 6306", "4929348385146307", "+1 (017) 555-7713", "+1+2 333 444 555", "+12", "12", " ", "\U0001f600é", "\n", "..", "a", "-", "("]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12))), "s") for i in range(400)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "1" * 30000 + "a" * 30000 + "@b" + ".c" * 20000, None), (903, "1 " * 20000, "s"), (904, "+1 " + "1" * 20000, "s"), (3, "again a@b.co", "s"), (3, "again a@b.co", "s")]
    got = personal_data.find_personal_data(frame(spark, rows)).select("id", personal_data.spell(personal_data.F.col("base")).alias("b"), personal_data.F.size("added").alias("n"))
    assert Counter((r["id"], r["b"]) for r in got.collect()) == Counter((i, ",".join(base_spans(t))) for i, t, _ in rows)
    assert personal_data.find_personal_data(frame(spark, rows).limit(0)).count() == 0


def test_bootstrapping(spark):
    rows = [(i, f"call phone: +1 (017) 555-77{i:02d} or the {i} end", "s") for i in range(10, 30)]
    rows += [(50, "phone: 555-0199-22 x", "s"), (51, "phone: none", "s"), (52, "the 12345678 thing", "s"), (53, "the +1 (017) 555-7799", "s"), (50, "phone: 555-0199-22 x", "s")]
    got = personal_data.find_personal_data(frame(spark, rows)).where("size(added) > 0").select("id", personal_data.spell(personal_data.F.col("added")).alias("a")).collect()
    assert [tuple(r) for r in got] == [(50, "phone:7:18")] * 2


W = r"[^\x20\x09-\x0D:=]*+[:=]|[^\x20\x09-\x0D:=]++"
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{32,}"


def bootstrapped(texts, min_seeds=3, confidence=0.6, plausible=0.1):
    """All spans beyond the base ones of each text, by plain loops."""
    key = lambda v: regex.sub(r"[^\p{L}\p{N}@]", "", v.lower())
    sorts = lambda v: tuple(bool(regex.search(x, v)) for x in (r"\p{L}", r"\p{N}", "@"))
    words = [re.findall(W, t.lower()) for t in texts]

    def contexts(a, b, c):
        return [x for x in (a and f"1 {a}", a and b and f"2 {b} {a}", a and c and f"r {a} {c}") if x]

    def slot(w, i):
        number = lambda j: j < len(w) and regex.search(r"^[^\p{L}]*[0-9][^\p{L}]*$", w[j])
        n = 1
        while n < 4 and number(i + n - 1) and not w[i + n - 1].endswith(tuple(",;.!?:=")) and number(i + n):
            n += 1
        get = lambda j: w[j] if 0 <= j < len(w) else None
        return n, key(" ".join(w[i : i + n])), contexts(get(i - 1), get(i - 2), get(i + n))

    slots = [[(i, *slot(w, i)) for i in range(1, len(w))] for w in words]
    places, seeds = [], [[] for _ in texts]  # (kind, value, contexts)
    for at, text in enumerate(texts):
        own = [x.split(":") for x in base_spans(text)]
        spans = [(k, int(a), int(b)) for k, a, b in own] + [("secret", m.start(), m.end()) for m in re.finditer(SECRET, text)]
        seeds[at] = spans
        for k, a, b in spans:
            # matches that failed bound the gaps too
            other = [m.span() for m in re.finditer(BASE.get(k, SECRET), text)]
            g = text[max([e for _, e in other if e <= a], default=0) : a].lower()
            h = text[b : min([s for s, _ in other if s >= b], default=len(text))].lower()
            w = re.findall(W, g)
            if g and re.search(r"[^\x20\x09-\x0D:=]$", g):
                if regex.search(r"[\p{L}\p{N}]", w[-1]):
                    continue
                w = w[:-1]
            after = re.search(rf"^[^\x20\x09-\x0D:=]*+[:=]?[\x20\x09-\x0D]*+({W})", h)
            if w and key(text[a:b]):
                places.append((k, key(text[a:b]), contexts(w[-1], w[-2] if len(w) > 1 else None, after and after[1])))
    known, tested, likely, taken = {(k, v) for k, v, _ in places}, set(), set(), set()
    while True:
        held = {}
        for k, v, cs in places:
            for c in cs:
                held.setdefault((k, c), []).append(v)
        fresh = {x for x, vs in held.items() if len(set(vs)) >= min_seeds} - tested
        tested |= fresh
        total = Counter(c for s in slots for *_, cs in s for c in cs)
        new_likely = {(k, c) for k, c in fresh if total[c] and len(held[k, c]) >= plausible * total[c]}
        if not new_likely:
            break
        likely |= new_likely
        edges = Counter((k, c, v) for s in slots for _, _, v, cs in s for k, c in likely if c in cs)

        def score(belief, edges=edges):
            got, n = Counter(), Counter()
            for (k, c, v), m in edges.items():
                got[k, c] += m * belief.get((k, v), 0.0)
                n[k, c] += m
            return {x: got[x] / n[x] for x in n}

        p = score(dict.fromkeys(known, 1.0))
        sure = {x for x, y in p.items() if y >= confidence}
        like = {(k, sorts(v)) for k, v in known}
        opened = {(k, v) for k, c, v in edges if (k, c) in sure and v and (k, v) not in known and (k, sorts(v)) in like}
        if not opened:
            break
        share = {}
        for k, v in opened:
            where = [cs for s in slots for _, _, w, cs in s if w == v]
            share[k, v] = min(1.0, sum(any((k, c) in sure for c in cs) for cs in where) / len(where) / 0.25)
        for _ in range(10):
            doubt = {}
            for k, c, v in edges:
                doubt[k, v] = doubt.get((k, v), 1.0) * (1 - min(p[k, c], 0.999) if p[k, c] >= confidence else 1)
            belief = {x: 1.0 if x in known else share.get(x, 0.0) * (1 - d) for x, d in doubt.items()}
            p = score(belief)
        new = {x for x in opened if belief[x] >= confidence}
        if not new:
            break
        known |= new
        for at, s in enumerate(slots):
            for i, n, v, cs in s:
                for k, w in new:
                    if v == w:
                        taken.add((at, k, i, n))
                        places.append((k, v, cs))
    order, out = [*BASE, "secret"], []
    for at, text in enumerate(texts):
        base = [s for s in seeds[at] if s[0] in BASE]
        apart = lambda x, some: all(x[2] <= y[1] or y[2] <= x[1] for y in some)
        secret = [s for s in seeds[at] if s[0] == "secret" and apart(s, base)]
        w, more = [m.span() for m in re.finditer(W, text)], set()
        for _, k, i, n in (x for x in taken if x[0] == at):
            first, last = text[slice(*w[i])], text[slice(*w[i + n - 1])]
            s = w[i][1] - len(re.sub(r"^[\"'(\[<{]+", "", first))
            e = w[i + n - 1][0] + len(re.sub(r"[\"')\]>},;:=!?.]+$", "", last))
            if s < e and apart((k, s, e), base + secret):
                more.add((k, s, e))
        out.append(",".join(f"{k}:{s}:{e}" for k, s, e in sorted([*secret, *more], key=lambda x: (order.index(x[0]), *x[1:]))))
    return out


def test_bootstrapping_against_loops(spark):
    rng = random.Random(14)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    odd = [f"{number(4)} {number(3)} {number(4)}" for _ in range(5)]
    texts = []
    for i in range(120):
        parts = [rng.choice(["so", "then he", "we", "mail", "the"]), rng.choice(["said", "went home.", "knew"])]
        kind = rng.randrange(8)
        if kind < 3:
            parts.append(f"reach me tel: {f'+49 {number(3)} {number(4)}22' if rng.random() < 0.75 else rng.choice(odd)} any time")
        elif kind == 3:
            parts.append(f"fax={rng.choice(odd)}, or so")  # the second round: only values that the first one found stand here
        elif kind == 4:
            parts.append(f"please write to a{number(2)}@ex{number(1)}.org today")
        elif kind == 5:
            parts.append(f"TOKEN = \"{'ab' + number(30)}\" end") if rng.random() < 0.7 else parts.append(f"token = 'k{number(12)}' end")
        elif kind == 6:
            parts.append(f"tel: {rng.choice(['none', 'the 12'])} given")
        rng.shuffle(parts)
        texts.append(" ".join([*words(rng, 4, 12), *parts, *words(rng, 3, 12)]))
    texts += ["fax=12 99 1", "İ tel: +49 123 456722, x", "", "tel:", "token = 'k5' token = 'k5'", odd[0]]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = personal_data.find_personal_data(frame(spark, rows)).select("id", personal_data.spell(personal_data.F.col("added")).alias("a")).collect()
    want = bootstrapped(texts)
    assert {r["id"]: r["a"] for r in got} == dict(enumerate(want))
    found = ",".join(want)
    assert found.count("phone:") > 10 and found.count("secret:") > 10


# chats


def test_chats(spark):
    rng = random.Random(9)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE=x]", "[/ROLE]", "\\", " ", "a", "\n", "é\U0001f600", "q", "z", "[", "<", "/"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool [x]", None, ""]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))]), "extra") for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(99, 0, "assistant", "same", "e"), (99, 0, "assistant", "same", "e"), (None, 1, "user", "x", "e"), (98, None, "user", "first", "e"), (98, 0, "assistant", "second", "e"), (97, 0, "user", "w " * 50000, "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(chat.render(turns)) and not got[c]["rewrites_history"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_rewriting_template():
    def renderer(turns):
        return "".join(f"<{r}>{x if k == len(turns) - 1 else x[-3:]}|" for k, (r, x) in enumerate(turns))

    text, spans, rewrites = chat.locate(renderer, [("u", "hello"), ("a", "world"), ("u", "bye")])
    assert rewrites and [text[a:b] for a, b in spans] == ["llo", "rld", "bye"]


# pages


def test_pages(spark):
    menu = "<nav><ul>" + "".join(f"<li><a href=/{k}>m{k}</a>" for k in range(5)) + "</ul></nav>"
    page = lambda k: f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{menu}<!-- ad --><div class='ad'>Buy {k}</div><article><h1>Head {k} &amp; more</h1><p><b>One &lt;x&gt;\n two.<br><p>Body&nbsp;{k}  text <a href=x>link</a> end</p><ul><li>i{k}<li>j</ul><div class=comments><p>nice!</div></article><footer>&copy; {k}</footer>" + ("</body></html>" if k % 2 else "")
    plain = lambda k: f"<html><body><div id=top-nav><a href=/>home</a></div><div class=wrap><div class=box>{''.join(f'<p>Sentence {k} {j} is long enough to matter.</p>' for j in range(3 + k % 3))}</div><div class=sidebar>side {k}</div><p class=cookie>We use cookies</p></div><form>f</form></body></html>"
    rows = [(k, f"http://a.example/{k}", page(k), "x", "y") for k in range(12)] + [(100 + k, f"https://b.example/{k}?x", plain(k), "x", "y") for k in range(9)]
    rows += [(200, None, None, "x", "y"), (201, "nonsense", "", "x", "y"), (202, "http://c.example/", "just text < 3 &", "x", "y"), (203, "http://c.example/u", "<p>a" * 3000, "x", "y"), (3, "http://a.example/3", page(3), "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert html_text.main_text(df).count() == len(rows)
    for k in range(12):
        assert got[k] == f"Head {k} & more\nOne <x> two.\nBody {k} text link end\ni{k}\nj"
    for k in range(9):
        assert got[100 + k] == "\n".join(f"Sentence {k} {j} is long enough to matter." for j in range(3 + k % 3))
    assert (got[200], got[201], got[202]) == ("", "", "just text < 3 &") and got[203] == "\n".join(["a"] * 3000)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_pages_wrapper_on_marked_hosts(spark):
    template = lambda k: f"<body><article><h1>Head {k}</h1><div class=box>Funded by readers, as on all pages.</div><p>Story {k} goes on.</p><p>Always</p></article></body>"
    teasers = lambda k: f"<body><article><p>Teaser {k}</article><div class=col>" + "".join(f"<p>Long sentence {k} {j} of the text itself.</p>" for j in range(4)) + "</div></body>"
    rows = [(k, f"http://a.example/{k}", template(k)) for k in range(6)] + [(100 + k, f"http://b.example/{k}", teasers(k)) for k in range(6)]
    rows += [(200 + k, "http://c.example/", template(1)) for k in range(6)] + [(300 + k, f"http://d.example/{k}", template(k)) for k in range(4)]
    rows += [(400 + k, f"http://e.example/{k}", f"<main><article><p>T{k}</article><p>Own text {k} in main.</main><p>Outside {k}") for k in range(3)]
    rows += [(500 + k, f"http://f.example/{k}", f"<article><p>Told {k}</article><p>Aside" if k % 3 == 0 else f"<div><p>{'A page without mark. ' * 9}{k}</div>") for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == f"Head {k}\nStory {k} goes on.\nAlways"
        assert got[100 + k] == "\n".join(f"Long sentence {k} {j} of the text itself." for j in range(4))
        assert "Funded by readers" in got[200 + k] and "Story 1" in got[200 + k]  # copies of one page say nothing
        assert got[500 + k] == (f"Told {k}" if k % 3 == 0 else f"{'A page without mark. ' * 9}{k}")
    assert all("Funded by readers" in got[300 + k] for k in range(4))
    assert all(got[400 + k] == f"T{k}\nOwn text {k} in main." for k in range(3))


def test_pages_of_random_templates(spark, tmp_path):
    """Pages are put together from blocks that are known to be content or not; some of the content is named like furniture."""
    from html import escape

    rng, rows, want = random.Random(15), [], {}
    sentence = lambda n: " ".join(words(rng, n, 5000)).capitalize() + rng.choice([".", " &", " <b>", "!"])
    for host in range(12):
        shells = rng.sample(["div class=wrap", "section", "div id=page", "main"], rng.randrange(3))
        box = rng.choice(["article", "div class=c7", "div class='entry'", "td"])
        menu, foot = [sentence(1) for _ in range(5)], sentence(6)
        for page in range(rng.choice([1, 7, 12])):
            body, out = [f"<h1>{escape(title := sentence(5))}</h1>"], [title]
            for _ in range(rng.randrange(3, 9)):
                texts = [sentence(rng.randrange(8, 30)) for _ in range(3)]
                kind = rng.randrange(6)
                if kind < 3:
                    body.append(f"<p{rng.choice(['', '', ' class=legal', ' class=\"related work\"'])}>{escape(texts[0])}</p>")
                    out.append(texts[0])
                elif kind == 3:
                    body.append("<ul>" + "".join(f"<li>{escape(x)}" for x in texts) + "</ul>")
                    out += texts
                elif kind == 4:
                    body.append(f"<div class='side tags'><p>{escape(texts[0])}</div>")
                    out.append(texts[0])
                else:
                    body.append(f"<aside>{escape(texts[0])}</aside><div class=comments><p>{escape(texts[1])}</div>")
            inner = f"<{box}>{''.join(body)}</{box.split()[0]}>"
            inner = f"<table><tr>{inner}</table>" if box == "td" else inner
            ad = f"<div class=ad>{escape(sentence(9))}</div>"
            html = "".join(f"<{x}>" for x in shells) + ad + inner + "".join(f"</{x.split()[0]}>" for x in reversed(shells))
            nav = "<nav>" + "".join(f"<a href=/>{escape(x)}</a> " for x in menu) + "</nav>"
            key = len(rows)
            rows.append((key, f"http://h{host}.example/{page}", f"<html><body>{nav}{html}<footer>{escape(foot)}</footer><div class=cookie>{escape(sentence(3))}</div>"))
            want[key] = "\n".join(out)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.op4_html_text(spark, str(tmp_path)).collect()}
    assert {k: got[k][0] for k in want} == want
    assert all(n == len(text) for text, n in got.values())


def test_alignment_is_longest():
    rng = random.Random(16)
    for _ in range(200):
        x, y = ([rng.choice("abcde") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        pairs = html_text.alignment(x, y)
        assert [i for i, _ in pairs if i is not None] == list(range(len(x))) and [j for _, j in pairs if j is not None] == list(range(len(y)))
        both = [(i, j) for i, j in pairs if i is not None and j is not None]
        assert all(x[i] == y[j] for i, j in both) and len(both) == best[-1][-1]
    html_text.alignment([str(k % 7) for k in range(20_000)], [str(k % 5) for k in range(20_000)])


def test_only_the_wrapper_finds_content():
    pages = [html_text.blocks(f"<body><nav>m</nav><div>{'Text of its own, and long. ' * 3}{k}<p>More {k}</div><div class=ad>Buy {k}</div>") for k in range(6)]
    whole = html_text.Wrapper()
    for p in pages:
        whole.add(*p)
    none = html_text.Wrapper(None, whole.slots)
    for found, _ in pages:
        assert "Buy" not in html_text.text_of(found, *whole.regions()) and "Buy" in html_text.text_of(found, *none.regions())


def test_wrapper_is_a_union_free_expression():
    w = html_text.Wrapper()
    for html in ("<ul><li>a<li>b</ul><p>x", "<ul><li>a</ul><h2>t</h2><p>x<p>y", "<dl><dt>a<dd>b<dt>c<dd>d</dl><p>x"):
        w.add(*html_text.blocks(html))
    shape = {k[0]: (k[1], k[2]) for k in w.tree[3]}
    assert shape == {"ul": (0, False), "h2": (0, False), "p": (1, True), "dl": (0, False)}
    dl = next(k for k in w.tree[3] if k[0] == "dl")
    assert [(k[0], k[2], [x[0] for x in k[3]]) for k in dl[3]] == [("()", True, ["dt", "dd"])]
    again = html_text.Wrapper.loads(w.dumps())
    again.merge(w)
    assert again.tree == w.tree
