"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. All successive prefixes of a
conversation are rendered and consecutive outputs compared: what a turn adds is its span; where an
output doesn't begin with the one before, the template rewrites history, and the turn is reported.
Where in its span a turn's text stands is found with two more renderings, with no text and with a
probe in its place; no other list than a prefix, but for the text of its last turn, is rendered. Where history was rewritten, the same is done on the whole conversation, so spans
always refer to the final output. A template that declares by an attribute `each` that it joins the strings
each(turn) is checked for that, and its turns are then rendered one by one. The loss mask covers the texts of `assistant` turns.

A conversation's rows are ordered by turn, then role, then text (ties and repeated rows stay); null
role or text counts as empty; a null conversation id is a group of its own. A conversation is
rendered in one task, as its digests are sequential; its own length bounds the memory. Columns other
than the four named are left out, so they cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.llm.common import field, read, to_arrow

PROBE = ""

# The template's control strings.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
CONTROL = re.compile(r"[\\:]|###|</turn>")
ROLE = re.compile(r"(?:\\.|[^\\:])*", re.S)
ESCAPED = re.compile(r"\\([\\:]|###|</turn>)")


@lru_cache(maxsize=256)
def escape(s: str) -> str:
    """s with a backslash before each control string; remembered, as each prefix of a conversation is rendered anew."""
    return CONTROL.sub(r"\\\g<0>", s) if CONTROL.search(s) else s


def unescape(s: str) -> str:
    return ESCAPED.sub(r"\1", s) if "\\" in s else s


def marked_turn(turn: tuple[str, str]) -> str:
    return f"{OPEN}{escape(turn[0])}{MIDDLE}{escape(turn[1])}{CLOSE}"


def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The template: `### role: text </turn>` lines; control strings inside role and text get a backslash."""
    return "".join(map(marked_turn, turns))


marked_turns.each = marked_turn


def read_back(out: str) -> list[tuple[str, str]]:
    """The turns of marked_turns()' output."""
    turns, at = [], 0
    while at < len(out):
        if not out.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        end = out.index(CLOSE, at)
        m = ROLE.match(out, at + len(OPEN))
        if not out.startswith(MIDDLE, m.end()):
            raise ValueError(f"no text at {m.end()}")
        turns.append((unescape(m[0]), unescape(out[m.end() + len(MIDDLE) : end])))
        at = end + len(CLOSE)
    return turns


def common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def text_span(render: Callable, before: list, turn: tuple, after: list, out: str) -> tuple[int, int]:
    """Where the turn's text stands in `out`, the output for before + turn + after."""
    empty = render([*before, (turn[0], ""), *after])
    start = common(empty, render([*before, (turn[0], PROBE), *after]))
    return start, start + max(0, len(out) - len(empty))


def joins(render: Callable, pieces: list[str], turns: list) -> bool:
    """Whether every prefix's output is its pieces joined."""
    return all(render(turns[:k]) == "".join(pieces[:k]) for k in range(1, len(turns) + 1))


def locate(render: Callable[[list], str], turns: list[tuple[str, str]]) -> dict:
    """out; turn spans and text spans in it; indexes of turns that rewrote what stood before.

    A template is given every prefix, so the work grows with the square of the conversation's length. Where render.each is
    declared and joins() holds, spans come from the turns' own pieces.
    """
    spans, texts, rewrote, at, prev = [], [], [], 0, ""
    each = getattr(render, "each", None)
    pieces = [each(t) for t in turns] if each else []
    if each and joins(render, pieces, turns):
        for turn, piece in zip(turns, pieces):
            a, z = text_span(lambda one: each(one[0]), [], turn, [], piece)
            texts.append((at + a, at + z))
            spans.append((at, at + len(piece)))
            at += len(piece)
        return {"out": "".join(pieces), "spans": spans, "texts": texts, "rewrote": []}
    for k, turn in enumerate(turns):
        cur = render(turns[: k + 1])
        start = common(prev, cur)
        if start < len(prev):
            rewrote.append(k)
        spans.append((start, len(cur)))
        texts.append(text_span(render, turns[:k], turn, [], cur) if not rewrote else None)
        prev = cur
    if rewrote:
        texts = [text_span(render, turns[:k], t, turns[k + 1 :], prev) for k, t in enumerate(turns)]
        cut = [0, *(a for a, _ in texts[1:]), len(prev)]
        spans = list(zip(cut, cut[1:]))
    return {"out": prev, "spans": spans, "texts": texts, "rewrote": rewrote}


def format_chats(rows: DataFrame, template: Callable[[list], str] = marked_turns, extra: DataFrame | None = None) -> DataFrame:
    """A row per conversation: conv_id, formatted, turn_spans, loss_spans, rewrote.

    rows, extra: conv_id, turn, role, text; conversations of `extra` stay apart from those of rows.
    """
    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    every = rows.select(*cols, F.lit(0).alias("part"))
    if extra is not None:
        every = every.unionByName(extra.select(*cols, F.lit(1).alias("part")))
    chats = every.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    fields = [field("formatted", "string"), field("turn_spans", "array<struct<a:int,z:int>>"), field("loss_spans", "array<struct<a:int,z:int>>"), field("rewrote", "array<int>")]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), *fields])

    def run(batches):
        import pyarrow as pa

        types = [to_arrow(f.dataType) for f in schema]
        for batch in batches:
            out = []
            for conv, turns in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = [(t["role"], t["text"]) for t in turns]
                got = locate(template, pairs)
                loss = [x for x, (role, _) in zip(got["texts"], pairs) if role == "assistant"]
                out.append((conv, got["out"], *([{"a": a, "z": z} for a, z in x] for x in (got["spans"], loss)), got["rewrote"]))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out) if out else [[]] * len(types), types)], names=schema.names)

    return chats.select("conv_id", "turns").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says when it is read back: numbers and digests of turns and of the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        import pyarrow as pa

        names = [p.split()[0] for p in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            out = []
            for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                turns = read_back(text)
                under = "".join(unescape(text[s["a"] : s["z"]]) for s in loss)
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), sha(under), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out) if out else [[]] * 6, types)], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(read(spark, sf_dir, "conversations"), extra=extra))


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES: dict[str, str] = {
    "op9_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, length(regexp_replace(role, '[\\:]|###|</turn>', '\\\0', 'g')) + length(regexp_replace(text, '[\\:]|###|</turn>', '\\\0', 'g')) + 15 AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""}
