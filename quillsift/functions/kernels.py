"""Per-string inspection and cleaning: pure functions, no Spark.

All decisions about an occurrence come from load_bearing(), for inspection and
cleaning alike. Each function is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import cache, lru_cache
from itertools import islice
from collections.abc import Iterator
from typing import NamedTuple

from quillsift.functions import taxonomy as T

NOT_EVALUATED = "statistical watermarks"
_CANDIDATE = re.compile(T.CANDIDATE)
_FLAGS = re.compile("(?<=" + T.FLAG + ")(?:" + "|".join("".join(chr(0xE0000 + ord(c)) for c in spec) + T.FLAG_END for spec in T.FLAG_SPECS) + ")(?![\U000e0000-\U000e007f])")
PROFILES = ("prose", "code", "data")
ROUNDS = 8


class Finding(NamedTuple):
    codepoint: int
    category: str
    severity: str
    name: str
    offset: int
    line: int
    column: int
    context: str


class Run(NamedTuple):
    text: str
    offset: int
    scripts: tuple[str, ...]
    span_start: int
    span_end: int
    suspicious_offsets: tuple[int, ...]

    @property
    def description(self) -> str:
        return f"{self.text!r} mixes {', '.join(self.scripts)}"


class Region(NamedTuple):
    start: int
    end: int
    mode: str


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    invisible = [(lo, hi) for lo, hi, c in T.category_ranges() if T.CATEGORIES[c] == "invisible"]
    joiner = (0x200C, 0x200D)
    open_ = T.runs_of([cp for lo, hi in [*invisible, *T.MODIFIERS] for cp in range(lo, hi + 1) if not joiner[0] <= cp <= joiner[1]])
    return (
        re.compile(T.python_class(invisible)),
        re.compile(T.python_class(open_) + "+"),
        re.compile("[\u200c\u200d\u115f\u1160\u17b4\u17b5]"),
        re.compile("[\ufe00-\ufe0d\ufe0e\ufe0f\U000e0100-\U000e01ef\u180b-\u180d]"),
    )


def load_bearing(text: str) -> frozenset[int]:
    """Offsets of the invisible characters that are content: emoji sequences, spelling, flags, variants."""
    if text.isascii():
        return frozenset()
    invisible, skipped, between, selector = _patterns()
    if not invisible.search(text):
        return frozenset()
    keep: set[int] = set()
    for m in selector.finditer(text):
        if (i := m.start()) and T.selects_here(ord(text[i - 1]), ord(text[i])):
            keep.add(i)
    for m in _FLAGS.finditer(text):
        keep.update(range(*m.span()))
    spots = [m.start() for m in between.finditer(text)]
    if spots:
        # Stretches that a neighbour search looks through, as sorted starts and ends.
        gaps = [m.span() for m in skipped.finditer(text)]
        starts, ends = [a for a, _ in gaps], [b for _, b in gaps]
        for i in spots:
            a = b = i
            # A filler lies within a gap itself; a joiner borders on at most two.
            g = bisect_right(starts, i) - 1
            if g >= 0 and i < ends[g]:
                a, b = starts[g], ends[g] - 1
            else:
                if g >= 0 and ends[g] == i:
                    a = starts[g]
                if g + 1 < len(gaps) and starts[g + 1] == i + 1:
                    b = ends[g + 1] - 1
            if a == 0 or b + 1 == len(text):
                continue
            left, right = ord(text[a - 1]), ord(text[b + 1])
            ch = text[i]
            if T.joins_here(left, right, ch == T.ZWJ) if ch in (T.ZWJ, T.ZWNJ) else T.fills_here(ch, left, right):
                keep.add(i)
    return frozenset(keep)


def is_load_bearing(text: str, index: int) -> bool:
    return index in load_bearing(text)


# --- inspection ---------------------------------------------------------------


class Lines:
    """Line and column of an offset; only line feeds end a line."""

    def __init__(self, text: str) -> None:
        self.feeds = [m.start() for m in re.finditer("\n", text)]

    def __call__(self, offset: int) -> tuple[int, int]:
        n = bisect_left(self.feeds, offset)
        return n + 1, offset - (self.feeds[n - 1] if n else -1)


_SHOWN = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
_ENDS = re.compile("[\n\r\t]")


def masked(text: str, keep: frozenset[int]) -> str:
    """The text with a dot for every invisible character that is not load-bearing; offsets stay."""
    return _patterns()[0].sub(lambda m: m.group() if m.start() in keep else "\u00b7", text)


def context_of(shown: str, ch: str, at: int, width: int = 24) -> str:
    """The neighbourhood of a character in a masked text."""
    lo, hi = max(0, at - width), min(len(shown), at + width + 1)
    before, after = (_ENDS.sub(lambda m: _SHOWN[m.group()], x) for x in (shown[lo:at], shown[at + 1 : hi]))
    return f"{'\u2026' * (lo > 0)}{before}[U+{ord(ch):04X}]{after}{'\u2026' * (hi < len(shown))}"


def findings(text: str, width: int = 24, keep: frozenset[int] | None = None) -> Iterator[Finding]:
    """Every flagged character that is not load-bearing, in order."""
    keep = load_bearing(text) if keep is None else keep
    lines = shown = None
    for m in _CANDIDATE.finditer(text):
        at = m.start()
        info = classified(ord(text[at]))
        if info is None or (info.severity == "invisible" and at in keep):
            continue
        lines = lines or Lines(text)
        shown = masked(text, keep) if shown is None else shown
        yield Finding(*info, at, *lines(at), context_of(shown, text[at], at, width))


classified = lru_cache(65_536)(T.classify)


@cache
def _word() -> re.Pattern:
    return re.compile(T.python_class(T.word_ranges()) + "{2,}")


@lru_cache(65_536)
def _mix_of(word: str) -> tuple[tuple[str, ...], tuple[int, ...]] | None:
    """Scripts of a word that mixes them, and where it leaves its majority script."""
    scripts = {ch: T.script_of(ord(ch)) for ch in set(word)}
    kinds = set(scripts.values()) - {"Common"}
    if len(kinds) < 2 or any(kinds <= mix for mix in T.ALLOWED_MIXES):
        return None
    counts = Counter(s for s in map(scripts.__getitem__, word) if s != "Common")
    most = max(counts.values())
    leading = [s for s, n in counts.items() if n == most]  # in order of appearance
    base = "Latin" if "Latin" in leading else leading[0]
    return tuple(sorted(kinds)), tuple(i for i, ch in enumerate(word) if scripts[ch] not in ("Common", base))


_script = lru_cache(65_536)(lambda ch: T.script_of(ord(ch)))


def _may_mix(text: str) -> bool:
    """Whether the scripts of all characters together are a mix; else no word's are."""
    kinds = set(map(_script, set(text))) - {"Common"}
    return len(kinds) > 1 and not any(kinds <= mix for mix in T.ALLOWED_MIXES)


def suspicious_runs(text: str, least: int = 2, limit: int | None = None) -> list[Run]:
    """Words that mix scripts, with the characters that don't fit the word's majority script."""
    out: list[Run] = []
    if text.isascii() or (limit is not None and limit <= 0) or not _may_mix(text):
        return out
    for m in _word().finditer(text):
        word = m.group()
        if len(word) < least or word.isascii() or (mix := _mix_of(word) if len(word) < 256 else _mix_of.__wrapped__(word)) is None:
            continue
        odd = tuple(m.start() + i for i in mix[1])
        out.append(Run(word, odd[0], mix[0], m.start(), m.end(), odd))
        if limit is not None and len(out) >= limit:
            break
    return out


def mixed_script_findings(text: str, width: int = 24, keep: frozenset[int] | None = None, limit: int | None = None) -> Iterator[Finding]:
    runs = suspicious_runs(text, limit=limit)
    if runs:
        keep = load_bearing(text) if keep is None else keep
        lines, shown = Lines(text), masked(text, keep)
        for r in runs:
            yield Finding(ord(text[r.offset]), "mixed_script", "confusable", r.description, r.offset, *lines(r.offset), context_of(shown, text[r.offset], r.offset, width))


def all_findings(text: str, width: int = 24) -> list[Finding]:
    """Characters and mixed words without any limit, in order."""
    if text.isascii() and not _CANDIDATE.search(text):
        return []
    keep = load_bearing(text)
    return sorted([*findings(text, width, keep), *mixed_script_findings(text, width, keep)], key=lambda f: (f.offset, f.category))


class Inspection(NamedTuple):
    findings: list[Finding]
    parse_status: str
    warnings: list[str]


def inspect(text: str, width: int = 24, max_text: int = T.MAX_TEXT, max_findings: int = T.MAX_FINDINGS) -> Inspection:
    if len(text) > max_text:
        return Inspection([], "resource_limit", [f"text has {len(text)} codepoints; limit is {max_text}"])
    if text.isascii() and not _CANDIDATE.search(text):
        return Inspection([], "complete", [])
    keep = load_bearing(text)
    found = list(islice(findings(text, width, keep), max_findings + 1))
    if len(found) <= max_findings:
        found += islice(mixed_script_findings(text, width, keep, max_findings - len(found) + 1), max_findings - len(found) + 1)
    cut = len(found) > max_findings
    found = sorted(found[:max_findings], key=lambda f: (f.offset, f.category))
    return Inspection(found, "resource_limit" if cut else "complete", [f"finding output truncated at {max_findings} occurrences"] if cut else [])


# --- folding ------------------------------------------------------------------


def fold_confusables(text: str) -> tuple[str, int]:
    """Compatibility forms anywhere, lookalikes only where a word mixes scripts; never part of cleaning."""
    odd = {i for r in suspicious_runs(text) for i in r.suspicious_offsets}
    out, changed = list(text), 0
    for m in _CANDIDATE.finditer(text):
        i, ch = m.start(), m.group()
        to = T.compatibility_ascii(ord(ch)) or (T.lookalikes().get(ch) if i in odd else None)
        if to is not None:
            out[i] = to
            changed += 1
    return "".join(out), changed


_FOLDS = {"all": str.maketrans(T.TYPOGRAPHY), "spaces": str.maketrans(T.SPACES)}
_FOLDED = {"all": re.compile(T.python_class(T.runs_of(list(map(ord, T.TYPOGRAPHY))))), "spaces": re.compile(T.python_class(T.runs_of(list(map(ord, T.SPACES)))))}

# --- regions ------------------------------------------------------------------

_FENCE = re.compile(r" {0,3}(?P<mark>`{3,}|~{3,})(?P<info>[^\r\n]*)")
_LABEL = r"\w(?:[\w-]{0,61}\w)?\."
_LINK = re.compile(
    r"(?<![\w@])(?:(?:https?|ftp)://|mailto:|www\.|[\w.!#$%&'*+/=?^_{}|~-]+@(?:" + _LABEL + r")+\w{2,63}|(?:" + _LABEL + r")+\w{2,63}(?=[:/?#]|[^\w-]|$))",
    re.I,
)
_TICKS = re.compile("`+")
_OPENERS = {")": "(", "]": "[", "}": "{"}


def fences(text: str) -> list[tuple[int, int]]:
    """Fenced code blocks; one that never closes runs to the end."""
    out, at, open_ = [], 0, None
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        if open_ is None:
            m = _FENCE.match(bare)
            if m and not (m["mark"][0] == "`" and "`" in m["info"]):
                open_ = (at, m["mark"])
        else:
            start, mark = open_
            body = bare.lstrip(" ")
            tail = body.rstrip(" \t")
            if len(bare) - len(body) <= 3 and len(tail) >= len(mark) and set(tail) == {mark[0]}:
                out.append((start, at + len(line)))
                open_ = None
        at += len(line)
    if open_ is not None:
        out.append((open_[0], len(text)))
    return out


def inline_code(text: str) -> list[tuple[int, int]]:
    """Runs of backticks pair with the next run of their length."""
    waiting: dict[int, int] = {}
    out = []
    for m in _TICKS.finditer(text):
        width = m.end() - m.start()
        if width in waiting:
            out.append((waiting.pop(width), m.end()))
        else:
            waiting[width] = m.start()
    return out


def _stops(ch: str) -> bool:
    return ch.isspace() or ch in '<>"`' or ch < " "


def links(text: str) -> list[tuple[int, int]]:
    """URLs, mail addresses and dotted names, without the prose punctuation after them."""
    out, at = [], 0
    if "." not in text and ":" not in text and "@" not in text:
        return out
    while m := _LINK.search(text, at):
        end = m.end()
        while end < len(text) and not _stops(text[end]):
            end += 1
        at = end
        count = Counter(c for c in text[m.start() : end] if c in "()[]{}")
        while end > m.start() and text[end - 1] in ".,;:!?":
            end -= 1
        while end > m.start() and (opener := _OPENERS.get(text[end - 1])) and count[text[end - 1]] > count[opener]:
            count[text[end - 1]] -= 1
            end -= 1
        if end > m.start():
            out.append((m.start(), end))
    return out


def protected_regions(text: str) -> list[Region]:
    """Disjoint regions: source where code is quoted, literal where an address stands. Earlier starts win."""
    found = [(a, p, b, mode) for p, (finder, mode) in enumerate(((fences, "source"), (inline_code, "source"), (links, "literal"))) for a, b in finder(text)]
    out: list[Region] = []
    for a, _, b, mode in sorted(found):
        if not out or a >= out[-1].end:
            out.append(Region(a, b, mode))
    return out


# --- cleaning -----------------------------------------------------------------


def strip_invisible(text: str) -> tuple[str, int]:
    """Without the invisible characters that are not load-bearing."""
    invisible = _patterns()[0]
    if not invisible.search(text):
        return text, 0
    keep = load_bearing(text)
    out = invisible.sub(lambda m: m.group() if m.start() in keep else "", text)
    return out, len(text) - len(out)


def _fold_piece(piece: str, table: str) -> tuple[str, int]:
    n = len(_FOLDED[table].findall(piece))
    return (piece.translate(_FOLDS[table]), n) if n else (piece, 0)


def fold(text: str, profile: str) -> tuple[str, int]:
    """One pass of folding: addresses stay, quoted code folds like code, the rest by profile."""
    ambient = "spaces" if profile == "prose" else "all"
    if not _FOLDED["all"].search(text):
        return text, 0
    out, total, at = [], 0, 0
    for start, end, mode in [*protected_regions(text), Region(len(text), len(text), "literal")]:
        for a, b, table in ((at, start, ambient), (start, end, "all" if mode == "source" else None)):
            piece, n = _fold_piece(text[a:b], table) if table else (text[a:b], 0)
            out.append(piece)
            total += n
        at = end
    return "".join(out), total


class Cleaned(NamedTuple):
    cleaned: str
    removed: int
    folded: int
    normalized: int
    changed: bool
    parse_status: str


def clean(text: str, profile: str = "prose", max_text: int = T.MAX_TEXT) -> Cleaned:
    """A fixed point of removing, line-end normalisation (data) and folding, each counted on its own."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    if len(text) > max_text:
        return Cleaned(text, 0, 0, 0, False, "resource_limit")
    if text.isascii() and not _CANDIDATE.search(text) and "\r\n" not in text:
        return Cleaned(text, 0, 0, 0, False, "complete")
    now, removed, folded, normalized = text, 0, 0, 0
    if profile == "data" and now[:1] == "\ufeff":
        now, normalized = now[1:], 1
    for _ in range(ROUNDS):
        before = now
        now, n = strip_invisible(now)
        removed += n
        if profile == "data":
            normalized += now.count("\r\n")
            now = now.replace("\r\n", "\n")
        for _ in range(ROUNDS):
            step, n = fold(now, profile)
            folded += n
            if step == now:
                break
            now = step
        if now == before:
            break
    else:
        raise RuntimeError("cleaning found no fixed point")
    return Cleaned(now, removed, folded, normalized, now != text, "complete")


# --- display ------------------------------------------------------------------

_UNSAFE = re.compile("[\x00-\x1f\x7f-\x9f\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069\ud800-\udfff]")


def terminal_safe(text: str) -> str:
    """Controls and direction marks as escapes."""
    return _UNSAFE.sub(lambda m: f"\\x{ord(m.group()):02x}" if ord(m.group()) < 0x100 else f"\\u{ord(m.group()):04x}", text)
