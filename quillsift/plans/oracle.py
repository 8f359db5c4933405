"""Relational SQL for DuckDB that re-derives what the kernels decide, character by character."""

from __future__ import annotations

import unicodedata
from functools import cache

from quillsift.functions import taxonomy as T
from quillsift.plans.dirty import dirty


def _values(rows) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


@cache
def dimensions() -> str:
    """rng, sets, fam, scr and dim as common table expressions."""
    sets = [(n, lo, hi) for n in ("emoji_base", "emoji_presentation_base", "standard_variant_base", "ideograph", "joins", "virama") for lo, hi in T.range_sets()[n][""]]
    sets += [("hangul", lo, hi) for lo, hi in T.range_sets()["script"]["Hangul"]] + [("khmer", 0x1780, 0x17FF)]
    sets += [("mongolian_letter", lo, hi) for lo, hi in T.runs_of([cp for cp in range(0x1800, 0x18B0) if unicodedata.category(chr(cp))[0] == "L"])]
    sets += [("word", lo, hi) for lo, hi in T.word_ranges()]
    fam = [(key, lo, hi) for key, rs in T.range_sets()["joining_family"].items() for a, b in rs for lo, hi in T.runs_of([cp for cp in range(a, b + 1) if unicodedata.category(chr(cp))[0] in "LM"])]
    scr = [(key, lo, hi) for key, rs in T.range_sets()["script"].items() for lo, hi in rs]
    return (
        f"rng(lo, hi, category) AS ({_values(T.category_ranges())}), sets(name, lo, hi) AS ({_values(sets)}), fam(family, lo, hi) AS ({_values(fam)}), scr(script, lo, hi) AS ({_values(scr)}), "
        f"dim(category, severity, rank) AS ({_values([(c, s, T.RANKS[s]) for c, s in T.CATEGORIES.items()])})"
    )


def _is(name: str) -> str:
    return f"EXISTS (SELECT 1 FROM sets WHERE name = '{name}' AND d.cp BETWEEN lo AND hi)"


@cache
def characters(table: str = "documents", key: str = "doc_id", text: str | None = None) -> str:
    """Up to `f`: every character of every text with a candidate, its flags and whether it is load-bearing."""
    spec = ", ".join(f"'{''.join(chr(0xE0000 + ord(c)) for c in s)}{T.FLAG_END}'" for s in T.FLAG_SPECS)
    cursive = ", ".join(f"'{c}'" for c in T.CURSIVE)
    return rf"""WITH {dimensions()},
src AS (SELECT {key}, {text or dirty(key=key)} AS text FROM {table}),
ch AS MATERIALIZED (SELECT {key}, unnest(range(len(string_split(text, '')))) AS pos, unnest(string_split(text, '')) AS c FROM src WHERE regexp_matches(text, '[^\t\n\r\x20-\x7e]')),
d AS (SELECT DISTINCT c, unicode(c) AS cp FROM ch),
flags AS MATERIALIZED (
  SELECT d.c, d.cp, r.category, dim.severity, dim.rank, {_is("emoji_base")} AS emoji, {_is("emoji_presentation_base")} AS pres, {_is("standard_variant_base")} AS std, {_is("ideograph")} AS ideo,
    {_is("joins")} AS joins, {_is("virama")} AS virama, {_is("hangul")} AS hangul, {_is("khmer")} AS khmer, {_is("mongolian_letter")} AS mong, {_is("word")} AS word,
    (SELECT max(family) FROM fam WHERE d.cp BETWEEN lo AND hi) AS family, coalesce((SELECT max(script) FROM scr WHERE d.cp BETWEEN lo AND hi), 'Common') AS script,
    d.cp IN (8204, 8205) OR NOT (d.cp BETWEEN 127995 AND 127999 OR coalesce(dim.severity = 'invisible', false)) AS barrier
  FROM d LEFT JOIN rng r ON d.cp BETWEEN r.lo AND r.hi LEFT JOIN dim ON dim.category = r.category),
x AS (
  SELECT ch.{key}, ch.pos, fl.*, lag(fl.cp) OVER w AS prev,
    last_value(CASE WHEN barrier THEN fl.cp END IGNORE NULLS) OVER (PARTITION BY ch.{key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lcp,
    first_value(CASE WHEN barrier THEN fl.cp END IGNORE NULLS) OVER (PARTITION BY ch.{key} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rcp,
    1 + coalesce(sum(CASE WHEN fl.cp = 10 THEN 1 END) OVER (PARTITION BY ch.{key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line,
    pos - coalesce(max(CASE WHEN fl.cp = 10 THEN pos END) OVER (PARTITION BY ch.{key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS col
  FROM ch JOIN flags fl ON fl.c = ch.c WINDOW w AS (PARTITION BY ch.{key} ORDER BY pos)),
tags AS (SELECT {key}, min(pos) AS a, max(pos) AS z, string_agg(c, '' ORDER BY pos) AS s, arg_min(prev, pos) AS base
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY {key} ORDER BY pos) AS g FROM x WHERE cp BETWEEN 917504 AND 917631) GROUP BY {key}, g),
f AS MATERIALIZED (
  SELECT x.*, coalesce(CASE
    WHEN x.cp BETWEEN 917504 AND 917631 THEN EXISTS (SELECT 1 FROM tags t WHERE t.{key} = x.{key} AND x.pos BETWEEN t.a AND t.z AND t.base = 127988 AND t.s IN ({spec}))
    WHEN x.cp IN (65038, 65039) THEN p.pres
    WHEN x.cp BETWEEN 65024 AND 65037 THEN p.std
    WHEN x.cp BETWEEN 917760 AND 917999 THEN p.ideo
    WHEN x.cp IN (8204, 8205) THEN (x.cp = 8205 AND l.emoji AND r.emoji) OR (l.family IS NOT NULL AND l.family = r.family AND (l.virama OR (l.family IN ({cursive}) AND l.joins AND r.joins)))
    WHEN x.cp IN (4447, 4448) THEN l.hangul AND r.hangul
    WHEN x.cp IN (6068, 6069) THEN l.khmer AND r.khmer
    WHEN x.cp BETWEEN 6155 AND 6157 THEN p.mong END, false) AS bearing
  FROM x LEFT JOIN flags p ON p.cp = x.prev LEFT JOIN flags l ON l.cp = x.lcp LEFT JOIN flags r ON r.cp = x.rcp),
found AS (SELECT * FROM f WHERE category IS NOT NULL AND NOT (severity = 'invisible' AND bearing)),
kept AS (SELECT {key}, coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE NOT coalesce(severity = 'invisible' AND NOT bearing, false)), '') AS text,
    CAST(count(*) FILTER (WHERE severity = 'invisible' AND NOT bearing) AS BIGINT) AS removed FROM f GROUP BY {key}),
stripped AS (SELECT src.{key}, coalesce(kept.text, src.text) AS text, coalesce(kept.removed, 0) AS removed, src.text AS given FROM src LEFT JOIN kept ON kept.{key} = src.{key})
"""


WORDS = """, wc AS (SELECT doc_id, pos, c, cp, script, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM f WHERE word),
ws AS (SELECT doc_id, g, script, count(*) AS n, min(pos) AS first FROM wc WHERE script <> 'Common' GROUP BY 1, 2, 3),
wb AS (SELECT doc_id, g, count(*) AS k, list_sort(list(script)) AS scripts, arg_max(script, struct_pack(n := n, latin := script = 'Latin', f := -first)) AS base FROM ws GROUP BY 1, 2),
runs AS (
  SELECT wc.doc_id, min(wc.pos) AS span_start, max(wc.pos) + 1 AS span_end, string_agg(c, '' ORDER BY wc.pos) AS text, any_value(wb.scripts) AS scripts,
    list_sort(list(wc.pos) FILTER (WHERE script NOT IN ('Common', wb.base))) AS suspicious_offsets
  FROM wc JOIN wb USING (doc_id, g) WHERE wb.k >= 2 AND NOT list_has_all(['Han', 'Hiragana', 'Katakana'], wb.scripts) AND NOT list_has_all(['Han', 'Hangul'], wb.scripts)
  GROUP BY wc.doc_id, wc.g)
"""


def fold_sql(text: str, profile: str) -> str:
    table = T.SPACES if profile == "prose" else {k: v for k, v in T.TYPOGRAPHY.items() if len(v) == 1}
    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({text}, {q(''.join(table))}, {q(''.join(table.values()))})"
    return out if profile == "prose" else f"replace({out}, '\u2026', '...')"


def folded_sql(text: str, profile: str) -> str:
    table = T.SPACES if profile == "prose" else T.TYPOGRAPHY
    return f"CAST(len(regexp_extract_all({text}, '{T.regex_class(T.runs_of([ord(c) for c in table]))}')) AS BIGINT)"


# --- regions --------------------------------------------------------------------------------
# The driver's texts quote no code, so every region is an address. One begins inside a run of characters
# without white space, quotes and angle brackets, and ends with that run but for the punctuation there.

_W = r"\p{L}\p{N}_"
_STOP = r"\x{00}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}<>\"`"
_HOST = rf"(?:[{_W}](?:[{_W}-]{{0,61}}[{_W}])?\.)+[{_W}]{{2,63}}"
_BEGIN = rf"(?:(?:https?|ftp)://|mailto:|www\.|[{_W}.!#$%&''*+/=?^{{}}|~-]+@{_HOST}|{_HOST}(?:[:/?#]|[^{_W}-]|$))"
_HEAD = rf"(?is)^(|.*?[^{_W}@]){_BEGIN}"


def _without_closer(of: str) -> str:
    """One closing bracket less at the end where it has no opening one."""
    more = " OR ".join(f"(right({of}, 1) = '{c}' AND len({of}) - len(replace({of}, '{c}', '')) > len({of}) - len(replace({of}, '{o}', '')))" for o, c in ("()", "[]", "{}"))
    return f"CASE WHEN {more} THEN left({of}, len({of}) - 1) ELSE {of} END"


def regions(src: str, key: str = "doc_id") -> str:
    """Common table expressions up to `piece`: (key, k, place, t, head, link) of every run; link is null where there is none."""
    return rf""", run AS (SELECT {key}, unnest(x) AS t, generate_subscripts(x, 1) AS k FROM (SELECT {key}, regexp_extract_all(text, '[^{_STOP}]+|[{_STOP}]+') AS x FROM {src})),
run1 AS (SELECT *, CASE WHEN regexp_matches(t, '[.:@][^.:@]') AND regexp_matches(t, '{_HEAD}') THEN regexp_extract(t, '{_HEAD}', 1) END AS head FROM run),
run2 AS (SELECT *, regexp_replace(substr(t, len(head) + 1), '[.,;:!?]+$', '') AS l0 FROM run1),
run3 AS (SELECT *, {_without_closer("l0")} AS l1 FROM run2), run4 AS (SELECT *, {_without_closer("l1")} AS l2 FROM run3),
piece AS (SELECT {key}, k, t, head, {_without_closer("l2")} AS link, sum(len(t)) OVER (PARTITION BY {key} ORDER BY k) - len(t) AS place FROM run4)"""


def folded_outside(src: str, profile: str, key: str = "doc_id") -> str:
    """`folded_text`: (key, text, folded) of src with everything but its regions folded."""
    rest = "substr(t, len(head) + len(link) + 1)"
    text = f"CASE WHEN link IS NULL THEN {fold_sql('t', profile)} ELSE {fold_sql('head', profile)} || link || {fold_sql(rest, profile)} END"
    n = f"CASE WHEN link IS NULL THEN {folded_sql('t', profile)} ELSE {folded_sql('head', profile)} + {folded_sql(rest, profile)} END"
    return regions(src, key) + f", outside AS (SELECT {key}, string_agg({text}, '' ORDER BY k) AS text, CAST(sum({n}) AS BIGINT) AS folded FROM piece GROUP BY {key}), folded_text AS (SELECT s.{key}, coalesce(o.text, '') AS text, coalesce(o.folded, 0) AS folded FROM {src} s LEFT JOIN outside o USING ({key}))"
