"""Turn spans of chat templates, found by rendering prefixes.

A template is a black box from a list of {role, content} to a string. It
renders the first 0, 1, 2, ... turns; where each output begins with the one
before it, what is new is the span of the added turn. A footer that every
output ends with (a generation prompt, say) is set aside first. Where an output
does not begin with the one before, the template rewrote history: the row
tells from which character on. A span holds in the final text if no later turn
rewrites before its end.

Defined results: turns are ordered by (turn, role, text), and repeated rows are
turns of their own; a null role or text is rendered as an empty string; a row
with a null conv_id is a conversation of its own; an empty text has a span of
its markup alone; a prefix that the template refuses by an exception gives kind
``error`` without a span, and the next turn's span covers it; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Render = Callable[[list[dict[str, str]]], str]
SPANS = "template string, conv_id bigint, turn bigint, role string, kind string, start bigint, end bigint, rewritten_from bigint, holds boolean, rewrites boolean"


def chatml(turns: list[dict[str, str]]) -> str:
    return "".join(f"<|im_start|>{t['role']}\n{t['content']}<|im_end|>\n" for t in turns)


def prompted(turns: list[dict[str, str]]) -> str:
    """Always ends with the header of the answer to come."""
    return "".join(f"<|{t['role']}|>\n{t['content']}\n" for t in turns) + "<|assistant|>\n"


def instruct(turns: list[dict[str, str]]) -> str:
    """A system turn goes into the first user turn; alone it can't be rendered."""
    out, held = [], ""
    for t in turns:
        if t["role"] == "system":
            held += f"<<SYS>>\n{t['content']}\n<</SYS>>\n\n"
        elif t["role"] == "user":
            out.append(f"<s>[INST] {held}{t['content']} [/INST]")
            held = ""
        else:
            out.append(f" {t['content']} </s>")
    if held:
        raise ValueError("a system turn needs a user turn after it")
    return "".join(out)


def first_lines(turns: list[dict[str, str]]) -> str:
    """Answers before the last turn keep their first line only, so later turns rewrite history."""
    last = len(turns) - 1
    return chatml([t if t["role"] != "assistant" or i == last else {**t, "content": t["content"].split("\n", 1)[0]} for i, t in enumerate(turns)])


TEMPLATES: dict[str, Render] = {"chatml": chatml, "prompted": prompted, "instruct": instruct, "first_lines": first_lines}


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving: slices compare faster than characters."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def common_suffix(a: str, b: str) -> int:
    return common_prefix(a[::-1], b[::-1])


def _steps(texts: list[str | None], footer: str) -> list[tuple[str, int | None, int | None, int | None]]:
    strip = lambda s: s[: len(s) - len(footer)] if footer and s.endswith(footer) else s
    before = strip(texts[0] or "")
    out: list[tuple[str, int | None, int | None, int | None]] = []
    for raw in texts[1:]:
        if raw is None:
            out.append(("error", None, None, None))
            continue
        now = strip(raw)
        if now.startswith(before):
            out.append(("append", len(before), len(now), None))
        else:
            at = common_prefix(before, now)
            out.append(("rewrite", at, len(now), at))
        before = now
    return out


def trace(render: Render, turns: list[dict[str, str]]) -> list[tuple[str, int | None, int | None, int | None, bool]]:
    """(kind, start, end, rewritten_from, holds) of each turn."""
    texts: list[str | None] = []
    for k in range(len(turns) + 1):
        try:
            texts.append(render(turns[:k]))
        except Exception:  # noqa: BLE001  the template is a black box
            texts.append(None)
    first = next((t for t in texts[1:] if t is not None), None)
    tries = [_steps(texts, "")]
    if texts[0] and first is not None and (n := common_suffix(texts[0], first)):
        footer = texts[0][len(texts[0]) - n :]
        if first.startswith(texts[0][: len(texts[0]) - n]):
            tries.append(_steps(texts, footer))
    # A start mark can look like a footer: the reading with fewer rewrites is right.
    steps = min(tries, key=lambda s: sum(x[0] == "rewrite" for x in s))
    out, reach = [], float("inf")
    for kind, start, end, at in reversed(steps):
        out.append((kind, start, end, at, end is not None and end <= reach))
        if at is not None:
            reach = min(reach, at)
    return out[::-1]


def spans(conversations: DataFrame, templates: dict[str, Render] | None = None) -> DataFrame:
    """One row per template and turn."""
    templates = templates or TEMPLATES
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = c.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SPANS.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        for b in batches:
            for conv, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                given = [{"role": t["role"] or "", "content": t["text"] or ""} for t in turns]
                rows = []
                for name, render in templates.items():
                    found = trace(render, given)
                    rewrites = any(x[0] == "rewrite" for x in found)
                    rows += [(name, conv, t["turn"], t["role"], *x, rewrites) for t, x in zip(turns, found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), types)], names=names)

    return grouped.mapInArrow(run, SPANS)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER w AS k, lag(role) OVER w AS prev, lag(coalesce(text, '')) OVER w AS px
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (
  SELECT *, length(r) + length(x) + 24 AS ml, length(r) + length(x) + 6 AS pl,
    CASE WHEN r = 'system' THEN length(x) + 19 WHEN r = 'user' THEN length(x) + 18 ELSE length(x) + 6 END AS il,
    length(r) + length(CASE WHEN r = 'assistant' THEN split_part(x, chr(10), 1) ELSE x END) + 24 AS cl,
    coalesce(prev = 'assistant' AND contains(px, chr(10)), false) AS rew FROM t),
s AS (
  SELECT *, sum(ml) OVER o AS me, sum(pl) OVER o AS pe, sum(il) OVER o AS ie, sum(cl) OVER o AS ce, lead(rew) OVER n AS next_rew, lag(cl) OVER n AS pcl,
    bool_or(rew) OVER (PARTITION BY conv_id) AS rws
  FROM p WINDOW n AS (PARTITION BY conv_id ORDER BY k), o AS (PARTITION BY conv_id ORDER BY k)),
i AS (SELECT *, coalesce(max(CASE WHEN r <> 'system' THEN ie END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ib FROM s)
SELECT 'chatml' AS template, conv_id, turn, role, 'append' AS kind, CAST(me - ml AS BIGINT) AS start, CAST(me AS BIGINT) AS "end", CAST(NULL AS BIGINT) AS rewritten_from, true AS holds, false AS rewrites FROM i
UNION ALL SELECT 'prompted', conv_id, turn, role, 'append', CAST(pe - pl AS BIGINT), CAST(pe AS BIGINT), NULL, true, false FROM i
UNION ALL SELECT 'instruct', conv_id, turn, role, CASE WHEN r = 'system' THEN 'error' ELSE 'append' END, CAST(CASE WHEN r <> 'system' THEN ib END AS BIGINT), CAST(CASE WHEN r <> 'system' THEN ie END AS BIGINT), NULL, r <> 'system', false FROM i
UNION ALL SELECT 'first_lines', conv_id, turn, role, CASE WHEN rew THEN 'rewrite' ELSE 'append' END,
  CAST(ce - cl - CASE WHEN rew THEN 11 ELSE 0 END AS BIGINT), CAST(ce - cl + ml AS BIGINT), CAST(CASE WHEN rew THEN ce - cl - 11 END AS BIGINT), NOT coalesce(next_rew, false), rws FROM i
"""
