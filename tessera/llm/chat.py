"""Operator 6: chat formatting by incremental black-box rendering.

A renderer is any function from turns to a string. Nothing is assumed of it: successive prefixes of a conversation are
rendered, each output is compared with the one before, and what came on top is the new turn's span; rendering the turn
with two different probe texts in its place tells where inside the span its text lies. An output that does not begin
with the one before shows that the template rewrites history; turns are then located in the final output, by probes.

Defined results: rows of a conversation are ordered by turn, then role, then text, nulls first; null role and null text
count as empty; repeated rows are turns of their own; conversations with a null id form one conversation; a table without
rows has no conversations; more columns pass by. One conversation is one output row, so its turns meet in one task; the
number of characters rendered grows with the square of that one conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Turn = tuple[str, str]
Renderer = Callable[[list[Turn]], str]

CONTROL = r"(?:\[/?INST\]|</?s>|<</?SYS>>|\[ROLE=[A-Za-z0-9%._~-]*\]|\[/ROLE\])"
_UNESCAPE = re.compile(rf"\\+(?={CONTROL})")
_OPEN = re.compile(r"(?:(\[INST\])|(<s>)|(<<SYS>>)|\[ROLE=([A-Za-z0-9%._~-]*)\]) ")
_CLOSE = (" [/INST]\n", " </s>\n", " <</SYS>>\n", " [/ROLE]\n")
_MAY = re.compile(CONTROL)


@lru_cache(maxsize=4096)
def escape(text: str) -> str:
    """Puts one more backslash in front of every control string; a control string of the template has none."""
    if not _MAY.search(text):
        return text
    return _MAY.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """The inverse of escape: takes one backslash away in front of every control string."""
    return _UNESCAPE.sub(lambda m: m[0][1:], text) if "\\" in text else text


def render(turns: list[Turn]) -> str:
    """The template: user, assistant and system turns have marks of their own, any other role is named in its mark."""
    out = []
    for role, text in turns:
        a, b = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}.get(role) or (f"[ROLE={quote(role, safe='')}]", "[/ROLE]")
        out.append(f"{a} {escape(text)} {b}\n")
    return "".join(out)


def parse(formatted: str) -> list[Turn]:
    """Reads the turns back from what render() wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = _OPEN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = "user" if m[1] else "assistant" if m[2] else "system" if m[3] else unquote(m[4])
        # a control string of a text has a backslash in front, so the first one with a blank there is the turn's own
        close = _CLOSE[m.lastindex - 1]
        end = formatted.index(close, m.end())
        out.append((role, unescape(formatted[m.end() : end])))
        at = end + len(close)
    return out


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common beginning and of the common end of two renderings that differ in one place."""
    head = _common(a, b)
    return head, _common(a[head:][::-1], b[head:][::-1])


def locate(renderer: Renderer, turns: list[Turn]) -> tuple[str, list[tuple[int, int]], bool]:
    """(output, the span of each turn's text in it, whether the template rewrites history)."""
    probes, before, spans, rewrites = ("q", "z"), renderer([]) if not turns else None, [], False
    before = before if before is not None else ""
    done: list[Turn] = []
    for role, text in turns:
        a, b = (renderer([*done, (role, p)]) for p in probes)
        done.append((role, text))
        now = renderer(done)
        if not now.startswith(before):
            rewrites = True
            break
        head, tail = _ends(a, b)
        spans.append((head, len(now) - tail))
        before = now
    if not rewrites:
        return before, spans, False
    final, spans = renderer(turns), []
    for k, (role, _) in enumerate(turns):
        a, b = (renderer([*turns[:k], (role, p), *turns[k + 1 :]]) for p in probes)
        head, tail = _ends(a, b)
        spans.append((head, max(head, len(final) - tail)) if a != b else (0, 0))
    return final, spans, True


SCHEMA = "conv_id long, formatted string, starts array<int>, ends array<int>, loss array<boolean>, rewrites boolean"


def format_chats(conversations: DataFrame, renderer: Renderer = render, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: the formatted text, the span of each turn's text, whether it is under the loss mask."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "formatted", "starts", "ends", "loss", "rewrites")}
            for conv, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                turns = [(t["role"], t["text"]) for t in ts]
                formatted, spans, rewrites = locate(renderer, turns)
                for k, v in zip(out, (conv, formatted, [s for s, _ in spans], [e for _, e in spans], [r in loss_roles for r, _ in turns], rewrites), strict=True):
                    out[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return whole.mapInArrow(rendered, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads turns and loss texts back from the formatted text and its mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = parse(r["formatted"])
                loss = "".join(unescape(r["formatted"][s:e]) for s, e, m in zip(r["starts"], r["ends"], r["loss"], strict=True) if m)
                rows.append((r["conv_id"], len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(r["formatted"]), r["rewrites"]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=names)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


OP6_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + len(regexp_extract_all(text, '{CONTROL}')) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 WHEN 'system' THEN 18 END) AS BIGINT) AS formatted_chars,
  false AS rewrites_history
FROM t GROUP BY conv_id
"""
