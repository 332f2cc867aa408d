"""Operator 2: drop a site's boilerplate lines by site-relative frequency, with DataFrame functions only.

A page is a row; its host is a column (documents have `source`). A line is what stands between line feeds, without
blanks at its ends. For each host, the pages that hold a line are counted (once a page) and divided by the host's
pages; lines above the ratio go, wherever on the host they stand. Lines move as 64-bit hashes with their lengths.

Defined results: a null text stays null and holds no lines; a null host is a host of its own; an empty line never goes;
a page that loses every line keeps an empty text; repeated rows are pages of their own; an empty table stays empty;
further columns pass through unchanged, but for those with the names of the counts, if asked for, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fresh, table

#: Share of a host's pages above which a line is boilerplate, and the pages that must hold it in any case.
MAX_RATIO, MIN_PAGES = 0.02, 5
#: A host's pages are dealt over so many salts when its lines must be shuffled to them.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line), F.length(F.trim(line)))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, gone): for each host that has any, the hashes of its boilerplate lines.

    A host with pages of L lines on average has at most L / max_ratio of them.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    seen = pages.select("host", F.explode(held).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    over = seen.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > max_ratio * F.col("pages"))
    return over.groupBy("host").agg(F.sort_array(F.collect_set("h")).alias("gone"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, lines_col: str | None = None, dropped_col: str | None = None) -> DataFrame:
    """docs with the text's boilerplate lines dropped; lines_col and dropped_col, if named, get the counts (long)."""
    of, lost, salt, deal, left = (fresh(f"__{n}", docs) for n in ("host", "gone", "salt", "deal", "kept"))
    gone = cut(boilerplate(docs, host_col, text_col, max_ratio, min_pages).select(F.col("host").alias(of), F.col("gone").alias(lost)))
    lines = gone.agg(F.coalesce(F.sum(F.size(lost)), F.lit(0))).first()[0]
    host, columns = F.col(host_col), docs.columns
    if lines <= BROADCAST_ROWS:
        with_gone = docs.join(F.broadcast(gone), host.eqNullSafe(F.col(of)), "left")
    else:
        # Too many for a broadcast: hosts are dealt over salts, so that a hot one meets its lines in many tasks.
        salted = gone.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn(deal, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(SALTS)).cast("int"))
        with_gone = dealt.join(salted, host.eqNullSafe(F.col(of)) & (F.col(deal) == F.col(salt)), "left").drop(deal, salt)
    kept = F.filter(_lines(F.col(text_col)), lambda x: (F.trim(x) == "") | ~F.array_contains(lost, _key(x)))
    out = with_gone.withColumn(left, F.when(F.col(lost).isNotNull(), kept).otherwise(_lines(F.col(text_col))))
    if lines_col:
        out = out.withColumn(lines_col, F.coalesce(F.size(_lines(F.col(text_col))), F.lit(0)).cast("long"))
    if dropped_col:
        out = out.withColumn(dropped_col, F.coalesce(F.size(_lines(F.col(text_col))) - F.size(left), F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.array_join(left, "\n"))).drop(of, lost, left)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, lines_col="n_lines", dropped_col="n_dropped").select("doc_id", "source", "text", "n_lines", "n_dropped")


OP2_SQL = f"""
WITH pages AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
seen AS (SELECT source, trim(line) AS line, count(DISTINCT r) AS n FROM lines WHERE trim(line) <> '' GROUP BY 1, 2),
gone AS (SELECT s.source, s.line FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
         WHERE s.n >= {MIN_PAGES} AND s.n > {MAX_RATIO} * t.pages),
marked AS (SELECT l.r, l.i, l.line, g.line IS NOT NULL AS dropped FROM lines l
           LEFT JOIN gone g ON l.source IS NOT DISTINCT FROM g.source AND trim(l.line) = g.line),
joined AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS text,
           count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped FROM marked GROUP BY r)
SELECT p.doc_id, p.source, CASE WHEN p.text IS NULL THEN NULL ELSE j.text END AS text,
       coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_dropped, 0) AS n_dropped
FROM pages p LEFT JOIN joined j USING (r)
"""
