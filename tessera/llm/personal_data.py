"""Operator 10: personal data by fixed expressions and by bootstrapped contextual extraction, with DataFrame functions only.

Seed entities are what fixed expressions find: the base spans (email, ip, card, phone) and secrets (long random tokens). Each
place of a seed induces lexical patterns of its kind: the word before it, the two words before it, and the words before and
after it. A pattern's slots are all places in the corpus with these words around them; patterns and the values in their slots
form a bipartite graph. Spark scores the patterns by the belief in the values of their slots, values by the patterns that hold
them and by the share of their occurrences that such patterns hold (so ordinary words, which stand everywhere, are not
believed), in turns until nothing changes. Believed values of confident patterns are new entities: all their occurrences are
spans, and in the next round they induce patterns in turn, until a round finds none.

Words end at ASCII white space and behind a colon or an equals sign, the case aside. A value is one word or a run of up to RUN
words of digits and separators; quotes, brackets and punctuation around it don't count, and values are told apart by their
letters, digits and @ only. A value is believed only if known values of the kind hold the same of these three sorts of characters.

Defined results: null text counts as empty and has no spans; an id may be null or repeated, each row is answered on its own
text; an empty table gives an empty result; other columns are ignored. Positions are code points, ends exclusive. Base spans
always stay; other spans never overlap them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, struct_array, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

#: The fixed expressions, with possessive repeats and anchored starts: the same leftmost matches, found in linear time.
FIND = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{32,}+",
}
#: Rows without these can't match, so the expression isn't tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9]{32}"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "k:int,s:int,e:int,m:string"

#: A word, and one that a run of numbers may hold or go on behind.
WORD = r"[^\x20\x09-\x0D:=]*+[:=]|[^\x20\x09-\x0D:=]++"
NUMBER, GOES_ON = r"^[^\p{L}]*[0-9][^\p{L}]*$", r"[^,;.!?:=]$"
#: What stands around a value in its words.
LEAD, TRAIL = r"^[\"'(\[<{]+", r"[\"')\]>},;:=!?.]+$"
#: Words in a value; words before slots up to which they are looked up in the scan itself and not joined to it.
RUN, ANCHORS = 4, 10_000
#: Share of a value's occurrences in slots from which on it counts as fully as one that stands nowhere else.
SHARE = 0.25


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.try_element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _checked(kind: str):
    return lambda x: _valid(kind, x["m"])


def _of_kind(i: int):
    return lambda x: x["k"] == i


def _located(text: Column, regex: str, kind: int) -> Column:
    """array<struct<k,s,e,m,g,h>> of all matches with the gaps before and behind them.

    Gaps and matches alternate, so their lengths add up to positions. They are added within blocks of about the square root
    of their number, as an array that grows is copied.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    empty = struct_array(SPAN + ",g:string,h:string")

    def placed(pairs: Column) -> Column:
        size = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(pairs))).cast("int"))

        def step(acc, z):
            s = acc["at"] + F.length(z["g"])
            e = s + F.length(z["m"])
            span = F.struct(F.lit(kind).alias("k"), s.alias("s"), e.alias("e"), z["m"].alias("m"), z["g"].alias("g"), z["h"].alias("h"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        def blocks(starts: Column) -> Column:
            length = F.transform(starts, lambda b: F.aggregate(F.slice(pairs, b, size), F.lit(0), lambda a, z: a + F.length(z["g"]) + F.length(z["m"])))
            before = F.aggregate(length, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
            return _let(before, lambda at: F.flatten(F.transform(starts, lambda b, i: F.aggregate(F.slice(pairs, b, size), F.struct(F.get(at, i).alias("at"), empty.alias("out")), step, lambda acc: acc["out"]))))

        return F.when(F.size(pairs) == 0, empty).otherwise(_let(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), size), blocks))

    def paired(cells: Column) -> Column:
        n = F.size(cells["found"])
        both = F.zip_with(cells["found"], F.slice(cells["gaps"], F.lit(1), n), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return F.zip_with(both, F.slice(cells["gaps"], F.lit(2), n), lambda x, h: F.struct(x["m"].alias("m"), x["g"].alias("g"), h.alias("h")))

    return _let(_let(F.struct(found.alias("found"), gaps.alias("gaps")), paired), placed)


def _spans(text: Column, kinds: tuple[str, ...], around: bool = False) -> Column:
    """The valid spans of the kinds, by kind, then start; around: with the gaps next to them."""
    out = []
    for kind in kinds:
        spans = F.filter(_located(text, FIND[kind], KINDS.index(kind)), _checked(kind))
        if not around:
            spans = F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
        out.append(F.when(text.rlike(NEEDS[kind]), spans).otherwise(struct_array(SPAN + (",g:string,h:string" if around else ""))))
    return F.concat(*out)


def base_spans(text: Column) -> Column:
    """array<struct<k,s,e,m>> of the base kinds. text must not be null."""
    return _spans(text, BASE)


def _key(value: Column) -> Column:
    """What tells values apart."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}@]", "")


def _sorts(key: Column) -> Column:
    """Which sorts of characters a value's key holds."""
    return F.concat(*[F.when(key.rlike(sort), name).otherwise("") for sort, name in ((r"\p{L}", "a"), (r"\p{N}", "9"), ("@", "@"))])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _contexts(before: Column, before2: Column, behind: Column) -> Column:
    """The patterns of a place, as texts; null where a word is missing."""
    some = lambda c: F.when(c != "", c)
    return F.array_compact(F.array(F.concat(F.lit("1 "), some(before)), F.concat(F.lit("2 "), some(before2), F.lit(" "), some(before)), F.concat(F.lit("r "), some(before), F.lit(" "), some(behind))))


def seed_places(rows: DataFrame) -> DataFrame:
    """(k, value, before, contexts, n): the places of the seeds in rows (text), equal ones counted."""
    x = rows.select(F.explode(_spans(F.col("text"), KINDS, True)).alias("x")).select("x.*")
    glued = F.col("g").rlike(r"[^\x20\x09-\x0D:=]$")
    x = x.withColumn("w", _words(F.col("g")))
    last = F.element_at("w", -1)
    # what is glued to a value is part of its word: marks around it, or letters, and then the place has no pattern
    skip = F.when(~glued, 0).when(~last.rlike(r"[\p{L}\p{N}]"), 1)
    at = F.size("w") - skip
    behind = F.regexp_extract(F.lower("h"), rf"^[^\x20\x09-\x0D:=]*+[:=]?[\x20\x09-\x0D]*+({WORD})", 1)
    x = x.select("k", _key(F.col("m")).alias("value"), F.get("w", at - 1).alias("before"), F.get("w", at - 2).alias("before2"), behind.alias("behind"))
    x = x.where("before <> '' and value <> ''").withColumn("contexts", _contexts(F.col("before"), F.col("before2"), F.col("behind")))
    return x.groupBy("k", "value", "before", "contexts").agg(F.count(F.lit(1)).alias("n"))


def _run(t: Column, i: Column) -> Column:
    """The number of words of the value that begins at i."""
    number = [F.coalesce(F.get(t, i + j).rlike(NUMBER), F.lit(False)) for j in range(RUN)]
    more = [number[j] & F.get(t, i + j).rlike(GOES_ON) & number[j + 1] for j in range(RUN - 1)]
    return reduce(lambda rest, j: F.when(more[j], rest).otherwise(F.lit(j + 1)), range(RUN - 2, -1, -1), F.lit(RUN))


def _value(t: Column, i: Column, n: Column) -> Column:
    return _key(F.array_join(F.slice(t, i + 1, n), " "))


def _places(rows: DataFrame, wanted, *keep: str) -> DataFrame:
    """rows' places, i being the position of the value's first word: (keep, i, n, before, contexts, value).

    wanted(t, i) says which places of the words t are looked at.
    """

    def place(t: Column, i: Column, n: Column) -> Column:
        before = F.get(t, i - 1)
        return F.struct(i.alias("i"), n.alias("n"), before.alias("before"), _contexts(before, F.get(t, i - 2), F.get(t, i + n)).alias("contexts"), _value(t, i, n).alias("value"))

    def places(t: Column) -> Column:
        at = F.filter(F.when(F.size(t) > 1, F.sequence(F.lit(1), F.size(t) - 1)).otherwise(F.array().cast("array<int>")), lambda i: wanted(t, i))
        return F.transform(at, lambda i: _let(_run(t, i), lambda n: place(t, i, n)))

    return rows.select(*keep, F.explode(_let(_words(F.col("text")), places)).alias("x")).select(*keep, "x.*")


def _slots(rows: DataFrame, patterns: DataFrame, *keep: str) -> DataFrame:
    """(keep, k, ctx, i, n, value) of all slots of the patterns (k, ctx, before)."""
    anchors = cut(patterns.select("before").distinct())
    n = anchors.count()
    if n <= ANCHORS:
        words = [r[0] for r in anchors.collect()]
        places = _places(rows, lambda t, i: F.get(t, i - 1).isin(words), *keep)
    else:
        places = _places(rows, lambda t, i: F.lit(True), *keep).join(small(anchors, n), "before", "left_semi")
    each = places.select(*keep, "i", "n", "value", F.explode("contexts").alias("ctx"))
    return each.join(small(patterns.select("k", "ctx"), patterns.count()), "ctx")


def _scored(edges: DataFrame, known: DataFrame, turns: int, confidence: float, specific: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """((k, ctx, p) of the patterns, (k, value, b) of the values) from the graph's edges (k, ctx, value, n).

    A pattern's p is the mean belief in its slots. A known value's belief is 1; another's is the chance that one of its
    confident patterns is right, times the share of its occurrences in slots (specific: k, value, share; 0 where not given).
    """
    known = known.select("k", "value", F.lit(1.0).alias("known")).distinct()
    e = cut(edges.groupBy("k", "ctx", "value").agg(F.sum("n").alias("n")).join(known, ["k", "value"], "left"))
    e = e.join(specific, ["k", "value"], "left") if specific is not None else e.withColumn("share", F.lit(0.0))
    e = cut(e.select("k", "ctx", "value", "n", F.coalesce("known", F.lit(0.0)).alias("known"), F.coalesce("share", F.lit(0.0)).alias("share")))
    belief, before = e.select("k", "value", F.col("known").alias("b")).distinct(), None
    for _ in range(turns):
        p = e.join(belief, ["k", "value"]).groupBy("k", "ctx").agg((F.sum(F.col("n") * F.col("b")) / F.sum("n")).alias("p"))
        p = cut(p)
        doubt = F.sum(F.when(F.col("p") >= confidence, F.log1p(-F.least(F.col("p"), F.lit(0.999)))).otherwise(0.0))
        belief = e.join(p, ["k", "ctx"]).groupBy("k", "value").agg(F.greatest(F.max("known"), F.max("share") * (1 - F.exp(doubt))).alias("b"))
        belief = cut(belief)
        now = p.agg(F.sum(F.round("p", 6))).first()[0]
        if now == before:
            break
        before = now
    return p, belief


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_seeds: int = 3, confidence: float = 0.6, plausible: float = 0.1, turns: int = 10, rounds: int = 8) -> DataFrame:
    """(id, text, base, added): arrays of struct<k,s,e,m>, k being the position in KINDS; added are secrets and discovered spans.

    min_seeds: distinct known values that must support a pattern. plausible: share of known values below which a pattern is
    not scored. confidence: score from which patterns discover, and belief from which values count as discovered. turns and
    rounds: the most there are of scoring and of bootstrapping; both end before when nothing changes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _discovered(rows, min_seeds, confidence, plausible, turns, rounds)
    apart = lambda some, others: F.filter(some, lambda x: ~F.exists(others, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    out = rows.withColumn("base", base_spans(F.col("text")))
    secrets = apart(_spans(F.col("text"), KINDS[len(BASE) :]), F.col("base"))
    if found is None:
        return out.select("id", "text", "base", secrets.alias("added"))
    keyed = out.withColumn("key", _row(F.col("text"))).join(found, "key", "left").withColumn("secrets", secrets)
    fresh = F.coalesce(apart(apart(F.col("fresh"), F.col("base")), F.col("secrets")), struct_array(SPAN))
    return keyed.select("id", "text", "base", F.array_sort(F.concat("secrets", fresh)).alias("added"))


def _row(text: Column) -> Column:
    """A text's key: texts are told apart by 128 bits."""
    return F.md5(text)


def _discovered(rows: DataFrame, min_seeds: int, confidence: float, plausible: float, turns: int, rounds: int) -> DataFrame | None:
    """(key, fresh): the spans of discovered values by text; None if there are none."""
    places = cut(seed_places(rows))
    known = places.select("k", "value").distinct()
    edges = tested = taken = None
    for _ in range(rounds):
        induced = places.select("k", "value", "before", "n", F.explode("contexts").alias("ctx")).groupBy("k", "ctx", "before").agg(F.count_distinct("value").alias("kinds"), F.sum("n").alias("n")).where(F.col("kinds") >= min_seeds)
        fresh = cut(induced.join(tested, ["k", "ctx"], "left_anti") if tested is not None else induced)
        if not fresh.count():
            break
        totals = _slots(rows, fresh).groupBy("k", "ctx").agg(F.count(F.lit(1)).alias("total"))
        likely = cut(fresh.join(totals, ["k", "ctx"]).where(F.col("n") >= plausible * F.col("total")))
        tested = cut(fresh.select("k", "ctx").union(tested) if tested is not None else fresh.select("k", "ctx"))
        if not likely.count():
            break
        more = _slots(rows, likely).groupBy("k", "ctx", "value").agg(F.count(F.lit(1)).alias("n"))
        edges = cut(edges.union(more) if edges is not None else more)
        p, _ = _scored(edges, known, 1, confidence, None)
        # what stands in slots of confident patterns and is not known: how much of it stands there, and where else it does
        open_values = edges.join(p.where(F.col("p") >= confidence), ["k", "ctx"], "left_semi").select("k", "value").distinct().join(known, ["k", "value"], "left_anti").where("value <> ''")
        alike = known.select("k", _sorts(F.col("value")).alias("sorts")).distinct()  # at most eight a kind
        open_values = cut(open_values.withColumn("sorts", _sorts(F.col("value"))).join(alike, ["k", "sorts"], "left_semi").select("k", "value"))
        n = open_values.count()
        if not n:
            break
        held = cut(_occurrences(rows, open_values.select("value").distinct(), n).join(small(open_values, n), "value"))
        # a place that several patterns hold counts once
        slots = held.select("k", "value", "key", "i", F.explode("contexts").alias("ctx")).join(p.where(F.col("p") >= confidence), ["k", "ctx"], "left_semi").select("k", "value", "key", "i").distinct()
        share = slots.groupBy("k", "value").agg(F.count(F.lit(1)).alias("inside")).join(held.groupBy("k", "value").agg(F.count(F.lit(1)).alias("all")), ["k", "value"])
        share = share.select("k", "value", F.least(F.lit(1.0), F.col("inside") / F.col("all") / SHARE).alias("share"))
        _, belief = _scored(edges, known, turns, confidence, share)
        new = cut(belief.where(F.col("b") >= confidence).join(known, ["k", "value"], "left_anti").join(open_values, ["k", "value"], "left_semi").select("k", "value"))
        n = new.count()
        if not n:
            break
        occurs = held.join(small(new, n), ["k", "value"], "left_semi")
        known = cut(known.union(new))
        taken = cut(occurs.select("k", "key", "i", "n").union(taken) if taken is not None else occurs.select("k", "key", "i", "n"))
        counted = occurs.groupBy("k", "value", "before", "contexts").agg(F.count(F.lit(1)).alias("n"))
        places = cut(places.union(counted.select(*places.columns)))
    if taken is None:
        return None
    return _positions(rows, taken)


def _occurrences(rows: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """(key, i, n, before, contexts, value) of all places of the values; equal texts are read once."""
    keyed = rows.select(_row(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    if n <= ANCHORS:
        words = [r[0] for r in values.collect()]
        # a value's first word is a prefix of it
        heads = sorted({w[:2] for w in words})
        return _places(keyed, lambda t, i: F.substring(_key(F.get(t, i)), 1, 2).isin(heads), "key").where(F.col("value").isin(words))
    return _places(keyed, lambda t, i: F.lit(True), "key").join(values, "value", "left_semi")


def _positions(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """(key, fresh) from places (k, key, i, n)."""
    by = taken.distinct().groupBy("key").agg(F.collect_list(F.struct("k", "i", "n")).alias("at"))
    texts = rows.select(_row(F.col("text")).alias("key"), "text").join(by, "key").dropDuplicates(["key"])

    def spans(w: Column) -> Column:
        def span(x: Column) -> Column:
            first, last = F.get(w, x["i"]), F.get(w, x["i"] + x["n"] - 1)
            s = first["s"] + F.length(first["m"]) - F.length(F.regexp_replace(first["m"], LEAD, ""))
            e = last["e"] - F.length(last["m"]) + F.length(F.regexp_replace(last["m"], TRAIL, ""))
            return F.struct(x["k"].alias("k"), s.cast("int").alias("s"), e.cast("int").alias("e"))

        return F.filter(F.transform("at", span), lambda x: x["s"] < x["e"])

    found = texts.select("key", "text", _let(_located(F.col("text"), WORD, -1), spans).alias("x"))
    full = F.transform("x", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.substring("text", x["s"] + 1, x["e"] - x["s"]).alias("m")))
    return found.select("key", F.array_sort(F.array_distinct(full)).alias("fresh"))


def spell(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
