"""Unicode facts: categories, severities, scripts, and character classes for both engines.

Everything is derived once on the driver from the interpreter's Unicode
database and data/ranges.tsv. Regular expressions get explicit code point
ranges only, since Java, RE2 and Python disagree about named classes.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache
from pathlib import Path
from typing import NamedTuple

MAX_TEXT = 1_000_000
MAX_FINDINGS = 10_000

#: category -> severity; the rank of a severity orders reports and thresholds.
CATEGORIES = {
    "zero_width": "invisible", "bidi_control": "invisible", "invisible_operator": "invisible", "deprecated_format": "invisible", "tag_character": "invisible",
    "variation_selector": "invisible", "script_invisible": "invisible", "control": "invisible", "other_format": "invisible",
    "word_joiner": "contextual", "soft_hyphen": "contextual", "normalization_control": "contextual", "private_use": "contextual",
    "exotic_space": "whitespace", "smart_quote": "typographic", "dash": "typographic", "ellipsis": "typographic", "compatibility_variant": "typographic",
    "confusable": "confusable", "mixed_script": "confusable",
}
RANKS = {"typographic": 1, "contextual": 2, "whitespace": 3, "confusable": 4, "invisible": 5}

#: In order of precedence: code points whose category does not follow from the Unicode database.
NAMED = (
    ("zero_width", "200b~200d feff"), ("word_joiner", "2060"), ("bidi_control", "200e~200f 202a~202e 2066~2069"), ("invisible_operator", "2061~2064"),
    ("deprecated_format", "206a~206f"), ("tag_character", "e0000~e007f"), ("variation_selector", "fe00~fe0f e0100~e01ef"), ("soft_hyphen", "ad"),
    ("normalization_control", "34f"), ("script_invisible", "115f~1160 17b4~17b5 180b~180e"), ("exotic_space", "a0 1680 2000~200a 202f 205f 3000"),
    ("smart_quote", "2018~201f"), ("dash", "2010~2015"), ("ellipsis", "2026"),
)
KEPT_CONTROLS = "\t\n\r"
ZWNJ, ZWJ = "\u200c", "\u200d"
MODIFIERS = ((0x1F3FB, 0x1F3FF),)
FLAG, FLAG_END = "\U0001f3f4", "\U000e007f"
FLAG_SPECS = ("gbeng", "gbsct", "gbwls")
CURSIVE = ("Adlam", "Arabic", "Hanifi Rohingya", "Mandaic", "Mongolian", "NKo", "Samaritan", "Syriac", "Thaana")
FILLER_NEIGHBOURS = {"\u115f": "Hangul", "\u1160": "Hangul", "\u17b4": "Khmer", "\u17b5": "Khmer"}
ALLOWED_MIXES = ({"Han", "Hiragana", "Katakana"}, {"Han", "Hangul"})


def parse_ranges(text: str) -> tuple[tuple[int, int], ...]:
    out = []
    for part in text.split():
        lo, _, hi = part.partition("~")
        out.append((int(lo, 16), int(hi or lo, 16)))
    return tuple(sorted(out))


@cache
def range_sets() -> dict[str, dict[str, tuple[tuple[int, int], ...]]]:
    out: dict[str, dict[str, tuple[tuple[int, int], ...]]] = {}
    for line in (Path(__file__).parents[1] / "data" / "ranges.tsv").read_text(encoding="ascii").splitlines():
        if line and not line.startswith("#"):
            name, key, ranges = line.split("\t")
            out.setdefault(name, {})[key] = parse_ranges(ranges)
    return out


class Ranges:
    """Membership by bisection over disjoint sorted ranges."""

    def __init__(self, ranges: tuple[tuple[int, int], ...]) -> None:
        self.ranges = ranges
        self.starts = [lo for lo, _ in ranges]

    def __contains__(self, cp: int) -> bool:
        i = bisect_right(self.starts, cp) - 1
        return i >= 0 and cp <= self.ranges[i][1]


@cache
def ranges(name: str, key: str = "") -> Ranges:
    return Ranges(range_sets()[name][key])


_NAMED = tuple((c, Ranges(parse_ranges(r))) for c, r in NAMED)
_FILLER_RANGES = {"Hangul": ranges("script", "Hangul"), "Khmer": ranges("joining_family", "Khmer")}


@lru_cache(65_536)
def compatibility_ascii(cp: int) -> str | None:
    """The printable ASCII that NFKC makes of a non-ASCII character, if it does."""
    if cp < 0x80:
        return None
    folded = unicodedata.normalize("NFKC", chr(cp))
    return folded if folded.isascii() and folded.isprintable() and folded != chr(cp) else None


@lru_cache(65_536)
def category(cp: int) -> str | None:
    if 0x20 <= cp < 0x7F or cp in (9, 10, 13):
        return None
    if cp < 0x80:
        return "control"
    for name, members in _NAMED:
        if cp in members:
            return name
    if compatibility_ascii(cp) is not None:
        return "compatibility_variant"
    return {"Cc": "control", "Co": "private_use", "Cf": "other_format"}.get(unicodedata.category(chr(cp)))


def severity(cp: int) -> str | None:
    c = category(cp)
    return CATEGORIES[c] if c else None


def is_invisible(cp: int) -> bool:
    return severity(cp) == "invisible"


def display_name(cp: int) -> str:
    general = unicodedata.category(chr(cp))
    stand_in = {"Cc": "<control>", "Co": "<private use>", "Cn": "<unassigned>", "Cs": "<surrogate>"}
    return unicodedata.name(chr(cp), stand_in.get(general, "<unnamed>"))


class CodepointInfo(NamedTuple):
    codepoint: int
    category: str
    severity: str
    name: str

    @property
    def escape(self) -> str:
        return f"U+{self.codepoint:04X}"


def classify(cp: int) -> CodepointInfo | None:
    c = category(cp)
    return CodepointInfo(cp, c, CATEGORIES[c], display_name(cp)) if c else None


def categories_for_severities(wanted: list[str]) -> list[str]:
    return sorted(c for c, s in CATEGORIES.items() if s in set(wanted))


@cache
def _labels(name: str) -> tuple[list[int], list[tuple[int, str]]]:
    rows = sorted((lo, hi, key) for key, rs in range_sets()[name].items() for lo, hi in rs)
    return [lo for lo, _, _ in rows], [(hi, key) for _, hi, key in rows]


def _label(name: str, cp: int) -> str | None:
    starts, ends = _labels(name)
    i = bisect_right(starts, cp) - 1
    return ends[i][1] if i >= 0 and cp <= ends[i][0] else None


@lru_cache(65_536)
def script_of(cp: int) -> str:
    return _label("script", cp) or "Common"


def scripts_in(text: str) -> set[str]:
    return {s for s in map(script_of, map(ord, set(text))) if s != "Common"}


@lru_cache(65_536)
def joining_family(cp: int) -> str | None:
    """The joining script of a letter or mark."""
    return _label("joining_family", cp) if unicodedata.category(chr(cp))[0] in "LM" else None


def is_emoji_base(cp: int) -> bool:
    return cp in ranges("emoji_base")


@lru_cache(65_536)
def is_barrier(cp: int) -> bool:
    """Whether a search for a joiner's neighbour stops here. Joiners do, hidden characters and skin tones don't."""
    if chr(cp) in (ZWJ, ZWNJ):
        return True
    return not (0x1F3FB <= cp <= 0x1F3FF or is_invisible(cp))


@lru_cache(65_536)
def joins_here(left: int, right: int, zwj: bool) -> bool:
    """Whether a joiner between these neighbours is spelling or glues an emoji."""
    if zwj and is_emoji_base(left) and is_emoji_base(right):
        return True
    family = joining_family(left)
    if family is None or family != joining_family(right):
        return False
    return left in ranges("virama") or (family in CURSIVE and left in ranges("joins") and right in ranges("joins"))


def fills_here(filler: str, left: int, right: int) -> bool:
    members = _FILLER_RANGES[FILLER_NEIGHBOURS[filler]]
    return left in members and right in members


@lru_cache(65_536)
def selects_here(base: int, selector: int) -> bool:
    """Whether a variation selector straight after this base is a known kind of sequence."""
    if selector in (0xFE0E, 0xFE0F):
        return base in ranges("emoji_presentation_base")
    if 0xFE00 <= selector <= 0xFE0D:
        return base in ranges("standard_variant_base")
    if 0xE0100 <= selector <= 0xE01EF:
        return base in ranges("ideograph")
    if 0x180B <= selector <= 0x180D:
        return 0x1800 <= base <= 0x18AF and unicodedata.category(chr(base))[0] == "L"
    return False


@cache
def lookalikes() -> dict[str, str]:
    return {chr(lo): key for key, rs in range_sets()["lookalike"].items() for lo, _ in rs}


#: What code and data profiles make of typography; prose folds the spaces only.
SPACES = {chr(cp): " " for lo, hi in parse_ranges(dict(NAMED)["exotic_space"]) for cp in range(lo, hi + 1)}
TYPOGRAPHY = SPACES | {c: "'" for c in "\u2018\u2019\u201a\u201b"} | {c: '"' for c in "\u201c\u201d\u201e\u201f"} | {chr(c): "-" for c in range(0x2010, 0x2016)} | {"\u2026": "..."}


def runs_of(cps: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for cp in sorted(cps):
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return [(a, b) for a, b in out]


def _assigned() -> Iterator[int]:
    """Code points worth a look: planes 0 to 3, tags and selectors, private use."""
    for lo, hi in ((0, 0xD7FF), (0xE000, 0x33FFF), (0xE0000, 0xE0FFF), (0xF0000, 0x10FFFF)):
        yield from range(lo, hi + 1)


@cache
def category_ranges() -> tuple[tuple[int, int, str], ...]:
    """Every flagged code point, as (lo, hi, category). Surrogates are not characters of a string column."""
    by: dict[str, list[int]] = {}
    # Ideographs and Hangul syllables are letters; planes 15 and 16 are private but for their last two code points.
    for lo, hi in ((0, 0x33FF), (0x4DC0, 0x4DFF), (0xA000, 0xABFF), (0xD7A4, 0xD7FF), (0xE000, 0x1FFFF), (0x2F800, 0x2FA1F), (0xE0000, 0xE0FFF)):
        for cp in range(lo, hi + 1):
            if c := category.__wrapped__(cp):
                by.setdefault(c, []).append(cp)
    rows = [(lo, hi, c) for c, cps in by.items() for lo, hi in runs_of(cps)]
    return tuple(sorted([*rows, (0xF0000, 0xFFFFD, "private_use"), (0x100000, 0x10FFFD, "private_use")], key=lambda r: (r[2], r[0])))


def regex_class(rs, negate: bool = False) -> str:
    """A bracket class of explicit code points that Java, RE2 and Python read alike (after `portable`)."""
    body = "".join(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in rs)
    return f"[{'^' if negate else ''}{body}]"


def python_class(rs) -> str:
    import re

    return "[" + "".join(re.escape(chr(lo)) + (f"-{re.escape(chr(hi))}" if hi > lo else "") for lo, hi in rs) + "]"


@cache
def category_class(*names: str) -> str:
    return regex_class([(lo, hi) for lo, hi, c in category_ranges() if c in names])


@cache
def severity_class(*names: str) -> str:
    return category_class(*categories_for_severities(list(names)))


@cache
def word_ranges() -> tuple[tuple[int, int], ...]:
    """Letters, numbers, underscore, and unassigned code points inside known scripts."""
    return tuple(runs_of([cp for cp in _assigned() if cp < 0xE0000 and (cp == 0x5F or chr(cp).isalnum() or (unicodedata.category(chr(cp)) == "Cn" and script_of(cp) != "Common"))]))


CANDIDATE = r"[^\t\n\r\x20-\x7e]"
