"""Column builders that stay in the JVM: prefilters, counts, folds, lookups and report logic."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions import taxonomy as T

_HEX = {"png": "89504e470d0a1a0a", "jpeg": "ffd8", "pdf": "25504446", "office": "504b0304"}


def is_candidate(text: Column) -> Column:
    """Whether anything but printable ASCII, tabs and line ends occurs; a superset of all findings."""
    return text.rlike(T.CANDIDATE)


def count_category(text: Column, *categories: str) -> Column:
    return F.regexp_count(text, F.lit(T.category_class(*categories))).cast("bigint")


@cache
def _pairs(kind: str) -> list[tuple[str, object]]:
    return sorted(T.CATEGORIES.items()) if kind == "severity" else sorted(T.RANKS.items())


def _lookup(kind: str, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in _pairs(kind) for x in pair])[key]


def severity_of(category: Column) -> Column:
    return _lookup("severity", category)


def rank_of(severity: Column) -> Column:
    return _lookup("rank", severity)


def exceeds(ranks: Column, threshold: str) -> Column:
    """Whether the highest rank of an array reaches the threshold's."""
    return F.coalesce(F.array_max(ranks) >= T.RANKS[threshold], F.lit(False))


def strip_controls(text: Column) -> Column:
    """All that can be hidden in an ASCII text."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def _translate(text: Column, table: dict[str, str]) -> Column:
    single = {k: v for k, v in table.items() if len(v) == 1}
    return F.translate(text, "".join(single), "".join(single.values()))


def fold_spaces(text: Column) -> Column:
    return _translate(text, T.SPACES)


def fold_typography(text: Column) -> Column:
    return F.replace(_translate(text, T.TYPOGRAPHY), F.lit("\u2026"), F.lit("..."))


def folded_count(text: Column, profile: str) -> Column:
    table = T.SPACES if profile == "prose" else T.TYPOGRAPHY
    return F.regexp_count(text, F.lit(T.regex_class(T.runs_of([ord(c) for c in table])))).cast("bigint")


def has_no_regions(text: Column) -> Column:
    """Surely without quoted code or addresses, so that folding needs no kernel."""
    return ~text.rlike(r"[`~.@:]")


@cache
def _compatibility() -> tuple[tuple[str, str], ...]:
    return tuple((chr(cp), T.compatibility_ascii(cp)) for lo, hi, c in T.category_ranges() for cp in range(lo, hi + 1) if T.compatibility_ascii(cp))


def fold_compatibility(text: Column) -> Column:
    """NFKC forms of ASCII: a translation; longer forms are replaced one by one, those that occur only."""
    longer = {k: v for k, v in _compatibility() if len(v) > 1}
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    some = T.regex_class(T.runs_of([ord(k) for k in longer]))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({some})"), F.lit(1)))
    widened = F.aggregate(found, text, lambda acc, c: F.replace(acc, c, F.element_at(table, c)))
    return _translate(F.when(text.rlike(some), widened).otherwise(text), dict(_compatibility()))


def detect_format(content: Column, path: Column | None = None) -> Column:
    """Container format by leading bytes; UTF-16 with a byte order mark is read as its ASCII characters for that."""
    head = F.substring(content, 1, 4096)
    marked = F.hex(head)
    wide = marked.rlike("^(FFFE|FEFF)")
    # A UTF-16 head loses its zero bytes and its mark; in UTF-8 a zero byte never stands in markup.
    plain = F.when(wide, F.regexp_replace(F.substring(marked, 5, 1 << 14), "00", "")).otherwise(F.regexp_replace(marked, "^EFBBBF", ""))
    lead = F.regexp_replace(plain, "^(?:09|0A|0B|0C|0D|20)+", "")
    out = F.when(F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(_HEX["png"].upper())), "png")
    for fmt in ("jpeg", "pdf", "office"):
        out = out.when(F.startswith(F.hex(F.substring(content, 1, 4)), F.lit(_HEX[fmt].upper())), fmt)
    xml = F.startswith(lead, F.lit(b"<?xml".hex().upper())) | F.startswith(lead, F.lit(b"<svg".hex().upper()))
    out = out.when(xml & plain.contains(b"<svg".hex().upper()), "svg")
    return out.when(F.lower(path).rlike(r"[^/]\.svg$"), "svg") if path is not None else out


def infer_profile(path: Column) -> Column:
    suffix = F.regexp_extract(F.lower(path), r"(?<=[^/])(\.[^./]+)$", 1)
    return F.when(suffix.isin(".md", ".markdown", ".txt", ".rst"), "prose").when(suffix.isin(".csv", ".tsv", ".json", ".jsonl"), "data").otherwise("code")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset; only line feeds end a line."""
    before = F.left(text, offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def column_of(text: Column, offset: Column) -> Column:
    return F.length(F.substring_index(F.left(text, offset), "\n", -1)).cast("bigint") + 1


# --- reports ------------------------------------------------------------------


def is_diagnostic(key: Column) -> Column:
    last = F.substring_index(key, ".", -1)
    return last.isin("parse_status", "coverage", "warning", "warnings", "refusal", "refusal_reason") | key.contains(".warning.") | key.contains(".refusal.")


def substantive(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, _: ~is_diagnostic(k))


def lifted(metadata: Column, kind: Column) -> dict[str, Column]:
    """parse_status, coverage, warnings and refusal_reasons out of a metadata map, with defaults by kind."""
    last = lambda k: F.substring_index(k, ".", -1)
    values = lambda keep: F.array_sort(F.map_values(F.map_filter(metadata, lambda k, _: keep(k))))
    status = F.coalesce(F.get(values(lambda k: last(k) == "parse_status"), F.lit(0)), F.when(kind == "text", "complete").when(kind == "unknown", "unsupported").otherwise("partial"))
    coverage = F.coalesce(F.get(values(lambda k: last(k) == "coverage"), F.lit(0)), F.when(kind == "text", "code points and mixed scripts").when(kind == "unknown", "no reader").otherwise("limited"))
    return {
        "parse_status": status, "coverage": coverage,
        "warnings": values(lambda k: last(k).isin("warning", "warnings") | k.contains(".warning.")),
        "refusal_reasons": values(lambda k: last(k).isin("refusal", "refusal_reason") | k.contains(".refusal.")),
    }


def notices(kind: Column, metadata: Column, parse_status: Column) -> Column:
    """What an inspection leaves open, as claims."""
    text = F.when(kind.isin("text", "svg"), "statistical text watermark")
    credential = F.when(~kind.isin("text", "office"), "C2PA credential and hard-binding validity")
    whole = F.when((kind != "text") & (parse_status != "complete"), "container parsing completeness")
    return F.array_compact(F.array(text, credential, whole))


def is_clean(parse_status: Column, total: Column, metadata: Column, warnings: Column, refusals: Column) -> Column:
    return (parse_status == "complete") & (total == 0) & (F.size(substantive(metadata)) == 0) & (F.size(warnings) == 0) & (F.size(refusals) == 0)


def inspect_exit(parse_status: Column, over_threshold: Column, failed: Column) -> Column:
    bad = parse_status.isin("unsupported", "malformed", "unsafe", "refused", "resource_limit")
    return F.when(failed | bad, 2).when(over_threshold, 1).otherwise(0)


def trim_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+\z", "")


def outcome(group: Column, given: Column, expect: Column, produced: Column, error: Column) -> dict[str, Column]:
    """passed, corrupted (a load-bearing case failed) and leaked (a contraband case failed)."""
    same = trim_line_ends(produced) == trim_line_ends(expect)
    passed = F.coalesce((F.coalesce(error, F.lit("")) == "") & same, F.lit(False))
    return {"is_removal": given != expect, "passed": passed, "corrupted": ~passed & (group == "load-bearing"), "leaked": ~passed & (group == "contraband")}
