"""Operator 5: mix sources to target token weights by entropy balancing.

Targets: the sources' weights share all words of the corpus; no source is asked for more than max_repeat times its
words, and what is above goes to the others by weight until none is above.

Rates: each document gets the rate, between 0 and max_repeat copies, that changes the uniform weights least in relative
entropy while its source's expected words equal the target. The solution tilts rates exponentially in document size,
rate = r e^(lambda z) / (r - 1 + e^(lambda z)) with z the size over the source's mean size, and one lambda a source. The
dual is convex and its Hessian diagonal, so each Newton iteration is one aggregation over the cells (source, size, number of
documents) of all sources, which gives the gradient and the curvature of every source at once; sources that have converged
stay as they are. Sums are of decimals, so their order doesn't matter. Only the number of open sources reaches the driver.

Copies: expected words are turned into whole copies from the longest size to the shortest of a source, each size repaying what
the longer ones left over (its cells, as many as it has distinct sizes, are rounded in one task); within a cell, dealt into parts
of about CELL rows, the odd copies go to the rows with the smallest hashes. Rows that are the same in what is hashed are one
entry with a count, so copies crowd no part.

Defined results: null text has size 0 and, its tilt being 0, one copy of nothing; a null source is a source of its own and
sorts last; repeated rows count as documents of their own; an empty table gives an empty result; more columns pass by.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, dense_index, fresh, small, table

WEIGHTS, MAX_REPEAT = (5, 2, 1), 3
#: Documents of one source and size are ranked in parts of about so many.
CELL = 500
#: Newton iterations at most, and between two looks at who is done; relative error of the words wanted at which a source is.
NEWTON, STEPS, EXACT = 120, 2, 1e-9


def measured(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """id, source, key (the source's name without null) and size of a document."""
    source = F.col(source_col).cast("string")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return {"id": F.col(id_col), "source": source, "key": F.coalesce(F.concat(F.lit("="), source), F.lit("")), "size": size}


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(key, source_size, target) for each source; only sums over the sources reach the driver."""
    per = cut(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    ranked = dense_index(per, "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).withColumn("most", max_repeat * F.col("source_size")))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = -1.0
    while True:
        full = F.col("most") < level * F.col("weight")
        capped, free = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        now = (total - capped) / free if free else level
        if now <= level:
            break
        level = now
    return ranked.select("key", "source_size", F.least(F.col("most").cast("double"), F.lit(max(level, 0.0)) * F.col("weight")).alias("target"))


def rates(cells: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(key, size, n, source_size, target, rate) from cells (key, size, n) and (key, source_size, target): the tilt of each source
    by Newton's method on the dual, kept inside a shrinking bracket."""
    per = cells.groupBy("key").agg(F.sum("n").alias("documents")).join(wanted, "key")
    given = (F.col("source_size") == 0) | (F.col("target") <= 0) | (F.col("target") >= most * F.col("source_size"))
    state = cut(per.withColumns({"lam": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "done": given}))
    n = state.count()
    z = F.col("size") * F.col("documents") / F.greatest("source_size", F.lit(1))

    def rate(lam: Column) -> Column:
        return F.lit(float(most)) / (1 + (most - 1) * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * z))))

    total = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    words = F.col("n") * F.col("size")
    for turn in range(NEWTON):
        open_cells = cells.join(small(state.where(~F.col("done")).select("key", "documents", "source_size", "lam"), n), "key").withColumn("rate", rate(F.col("lam")))
        sums = open_cells.groupBy("key").agg(total(words * F.col("rate")).alias("got"), total(words * z * F.col("rate") * (1 - F.col("rate") / most)).alias("slope"))
        state = state.join(small(sums, n), "key", "left")
        off = F.col("got") - F.col("target")
        arrived = F.coalesce(F.abs(off) <= EXACT * F.col("target"), F.lit(True))
        low, high = F.when(off > 0, F.col("low")).otherwise(F.col("lam")), F.when(off > 0, F.col("lam")).otherwise(F.col("high"))
        state = state.withColumns({"arrived": F.col("done") | arrived, "low": low, "high": high})
        step = F.when(F.col("slope") > 0, F.col("lam") - off / F.col("slope"))
        bounded = (F.col("low") > float("-inf")) & (F.col("high") < float("inf"))
        middle = F.when(bounded, (F.col("low") + F.col("high")) / 2).when(off < 0, 2 * F.col("lam") + 1).otherwise(2 * F.col("lam") - 1)
        good = (step > F.col("low")) & (step < F.col("high")) & (F.abs(step - F.col("lam")) <= 1 + F.abs("lam"))
        moved = F.when(F.col("arrived"), F.col("lam")).otherwise(F.when(F.coalesce(good, F.lit(False)), step).otherwise(middle))
        state = state.select("key", "documents", "source_size", "target", moved.alias("lam"), "low", "high", F.col("arrived").alias("done"))
        if turn % STEPS == STEPS - 1:
            state = cut(state)
            if not state.where(~F.col("done")).count():
                break
    else:
        raise RuntimeError("mixing: a source's rates have not converged")
    # the last digits, which no result may hang on, go
    lam = F.round("lam", 9)
    fixed = F.when((F.col("source_size") == 0) | (F.col("target") <= 0), 0.0).when(F.col("target") >= most * F.col("source_size"), float(most)).otherwise(rate(lam))
    both = cells.join(small(state, n), "key")
    return both.select("key", "size", "n", "source_size", "target", F.when(F.col("size") == 0, 1.0).otherwise(fixed).alias("rate"))


def whole(size: np.ndarray, count: np.ndarray, rate: np.ndarray, most: int) -> np.ndarray:
    """Copies for each size, given from long to short so that the words taken keep up with the words wanted."""
    out, want, got = np.zeros(len(size), dtype=np.int64), 0.0, 0
    for i in range(len(size)):
        s, c = int(size[i]), int(count[i])
        want += c * s * rate[i]
        n = min(most * c, max(0, int(np.floor((want - got) / s + 0.5)))) if s else c
        out[i] = n
        got += n * s
    return out


def _rounded(most: int):
    def of_source(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ascending=False, kind="mergesort").reset_index(drop=True)
        return part.assign(copies=whole(part["size"].to_numpy(), part["n"].to_numpy(), part["rate"].to_numpy(), most))

    return of_source


ENTRY = ("id", "key", "size", "h")


def entries(rows: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """(id, key, size, h, m, source_size, target, rate, parts, part, at, each, odd) from rows (id, source, key, size, h).

    An entry is m rows that are the same. Each of them gets `each` copies and `odd` of them one more; at is the place of the entry's
    hash among those of its part, by which odd copies are given.
    """
    counted = cut(rows.groupBy("source", *ENTRY).agg(F.count(F.lit(1)).alias("m")))
    cells = cut(counted.groupBy("key", "size").agg(F.sum("m").alias("n")))
    wanted = targets(counted.select("key", "source", (F.col("size") * F.col("m")).alias("size")), weights, max_repeat)
    rated = rates(cells, cut(wanted), max_repeat)
    solved = cut(rated.groupBy("key").applyInPandas(_rounded(max_repeat), "key string, size long, n long, source_size long, target double, rate double, copies long"))
    n = solved.count()
    solved = solved.withColumn("parts", F.ceil(F.col("n") / CELL).cast("int"))
    placed = counted.join(small(solved, n), ["key", "size"]).withColumn("part", F.pmod("h", F.col("parts")).cast("int"))
    placed = placed.withColumn("at", F.xxhash64("h", F.lit(1)))
    # the odd copies of a cell, shared by its parts as their rows are many
    held = cut(placed.where("parts > 1").groupBy("key", "size", "part").agg(F.sum("m").alias("held")))
    upto = F.sum("held").over(Window.partitionBy("key", "size").orderBy("part"))
    shares = held.withColumn("upto", upto).join(small(solved.select("key", "size", "n", (F.col("copies") % F.col("n")).alias("odd")), n), ["key", "size"])
    part_of = lambda c: F.floor(F.col("odd").cast("decimal(38,0)") * c / F.col("n")).cast("long")
    shares = cut(shares.select("key", "size", "part", (part_of(F.col("upto")) - part_of(F.col("upto") - F.col("held"))).alias("own")))
    dealt = placed.join(small(shares, shares.count()), ["key", "size", "part"], "left")
    own = F.coalesce("own", F.when(F.col("parts") == 1, F.col("copies") % F.col("n")), F.lit(0))
    before = F.sum("m").over(Window.partitionBy("key", "size", "part").orderBy("at", "id", "h").rowsBetween(Window.unboundedPreceding, -1))
    odd = F.greatest(F.lit(0), F.least(F.col("m"), own - F.coalesce(before, F.lit(0))))
    return dealt.select(*ENTRY, "m", "source_size", "target", "rate", "parts", "part", "at", F.floor(F.col("copies") / F.col("n")).cast("long").alias("each"), odd.cast("long").alias("odd"))


def _repeated(df: DataFrame, times: Column, name: str) -> DataFrame:
    """df with each row standing there so many times, numbered from 0 in a column; in two steps, as the number has no bound."""
    step = 4096
    first = fresh("__chunk", df)
    df = df.withColumn(name, times).where(F.col(name) > 0).withColumn(first, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(name) - 1) / step))))
    last = F.least(F.col(name), (F.col(first) + 1) * step) - 1
    return df.withColumn(name, F.explode(F.sequence(F.col(first) * step, last))).drop(first)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(id, key, size, source_size, target, rate, copies) for every row."""
    rows = docs.select(*[c.alias(n) for n, c in measured(id_col, text_col, source_col).items()], F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"))
    got = _repeated(entries(rows, weights, max_repeat), F.col("m"), "nth")
    copies = F.col("each") + F.when(F.col("nth") < F.col("odd"), 1).otherwise(0)
    return got.select("id", "key", "size", "source_size", "target", "rate", copies.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs with each row standing there as often as the mix copies it, possibly not at all; the columns are docs' own.

    A row finds its copies by its source, size and hash: it has an odd copy if its hash is not above its part's last one that has.
    """
    names = {n: fresh(f"__{n}", docs) for n in ("id", "source", "key", "size", "h", "parts", "part", "at", "each", "last", "copies", "nth")}
    of = lambda n: F.col(names[n])
    made = measured(id_col, text_col, source_col) | {"h": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}
    got = cut(entries(docs.select(*[c.alias(n) for n, c in made.items()]), weights, max_repeat))
    rules = cut(got.groupBy("key", "size", "parts", "part").agg(F.first("each").alias("each"), F.max(F.when(F.col("odd") == F.col("m"), F.col("at"))).alias("last")))
    cells = rules.select("key", "size", "parts").distinct()
    rename = lambda df: df.select(*[F.col(c).alias(names[c]) for c in df.columns])
    n = rules.count()
    keyed = docs.withColumns({names[c]: made[c] for c in ("key", "size", "h")})
    keyed = keyed.join(small(rename(cells), n), [names["key"], names["size"]]).withColumn(names["part"], F.pmod(of("h"), of("parts")).cast("int"))
    ruled = keyed.join(small(rename(rules.drop("parts")), n), [names[c] for c in ("key", "size", "part")])
    copies = of("each") + F.when(F.xxhash64(of("h"), F.lit(1)) <= of("last"), 1).otherwise(0)
    out = _repeated(ruled, copies, names["copies"]).select(*docs.columns)
    # of rows that are the same, some may have one copy more than others: which of them does not matter
    split = cut(got.where("odd > 0 and odd < m").select("h", F.col("odd").alias("copies")))
    k = split.count()
    if not k:
        return out
    more = docs.withColumn(names["h"], made["h"]).join(small(rename(split), k, 24), names["h"]).dropDuplicates([names["h"]])
    return out.union(_repeated(more, of("copies"), names["nth"]).select(*docs.columns))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate")
