"""Queries over fixed cases, each with the result that Unicode or a format's specification prescribes.

The expected values are literals of their own: they share no table with the engine.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import columns as C
from quillsift.functions import kernels as K
from quillsift.functions import taxonomy as T
from quillsift.functions import udfs as U
from quillsift.operators import inspection
from quillsift.plans import samples as S
from quillsift.sources import containers


def values(rows: list[tuple], *names: str) -> str:
    """SQL for these rows; lists are lists of strings or numbers."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return f"[{', '.join(map(lit, v))}]" if v else "CAST([] AS VARCHAR[])"
        if isinstance(v, str):
            # Control and format characters by number, so that the statement survives any transport.
            parts, plain = [], ""
            for ch in v:
                if ch.isprintable() and ch != "'":
                    plain += ch
                else:
                    parts += [f"'{plain}'"] * bool(plain) + [f"chr({ord(ch)})"]
                    plain = ""
            parts += [f"'{plain}'"] * (bool(plain) or not parts)
            return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]
        return f"CAST({v} AS BIGINT)"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(f'"{n}"' for n in names)})"


def _points(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(r[0],) for r in rows], "codepoint int")


def _texts(spark: SparkSession, rows: list[tuple], *more: str) -> DataFrame:
    """The distinct leading columns of the rows: a text, and what is asked of it."""
    names = ["text", *more]
    return spark.createDataFrame(sorted({r[: len(names)] for r in rows}), ", ".join(f"{n} string" for n in names))


#: Code point, category, severity, name
CLASSES = [
    (0x200B, "zero_width", "invisible", "ZERO WIDTH SPACE"), (0x200C, "zero_width", "invisible", "ZERO WIDTH NON-JOINER"), (0x200D, "zero_width", "invisible", "ZERO WIDTH JOINER"), (0xFEFF, "zero_width", "invisible", "ZERO WIDTH NO-BREAK SPACE"),
    (0x2060, "word_joiner", "contextual", "WORD JOINER"), (0xAD, "soft_hyphen", "contextual", "SOFT HYPHEN"), (0x34F, "normalization_control", "contextual", "COMBINING GRAPHEME JOINER"), (0xE000, "private_use", "contextual", "<private use>"), (0x10FFFD, "private_use", "contextual", "<private use>"),
    (0x200E, "bidi_control", "invisible", "LEFT-TO-RIGHT MARK"), (0x200F, "bidi_control", "invisible", "RIGHT-TO-LEFT MARK"), (0x202A, "bidi_control", "invisible", "LEFT-TO-RIGHT EMBEDDING"), (0x202E, "bidi_control", "invisible", "RIGHT-TO-LEFT OVERRIDE"), (0x2066, "bidi_control", "invisible", "LEFT-TO-RIGHT ISOLATE"), (0x2069, "bidi_control", "invisible", "POP DIRECTIONAL ISOLATE"),
    (0x2061, "invisible_operator", "invisible", "FUNCTION APPLICATION"), (0x2064, "invisible_operator", "invisible", "INVISIBLE PLUS"), (0x206A, "deprecated_format", "invisible", "INHIBIT SYMMETRIC SWAPPING"), (0x206F, "deprecated_format", "invisible", "NOMINAL DIGIT SHAPES"),
    (0xE0001, "tag_character", "invisible", "LANGUAGE TAG"), (0xE0041, "tag_character", "invisible", "TAG LATIN CAPITAL LETTER A"), (0xE007F, "tag_character", "invisible", "CANCEL TAG"),
    (0xFE00, "variation_selector", "invisible", "VARIATION SELECTOR-1"), (0xFE0F, "variation_selector", "invisible", "VARIATION SELECTOR-16"), (0xE0100, "variation_selector", "invisible", "VARIATION SELECTOR-17"), (0xE01EF, "variation_selector", "invisible", "VARIATION SELECTOR-256"),
    (0x115F, "script_invisible", "invisible", "HANGUL CHOSEONG FILLER"), (0x1160, "script_invisible", "invisible", "HANGUL JUNGSEONG FILLER"), (0x17B4, "script_invisible", "invisible", "KHMER VOWEL INHERENT AQ"), (0x180B, "script_invisible", "invisible", "MONGOLIAN FREE VARIATION SELECTOR ONE"), (0x180E, "script_invisible", "invisible", "MONGOLIAN VOWEL SEPARATOR"),
    (0x7, "control", "invisible", "<control>"), (0x7F, "control", "invisible", "<control>"), (0x85, "control", "invisible", "<control>"), (0xFFF9, "other_format", "invisible", "INTERLINEAR ANNOTATION ANCHOR"), (0x61C, "other_format", "invisible", "ARABIC LETTER MARK"),
    (0xA0, "exotic_space", "whitespace", "NO-BREAK SPACE"), (0x1680, "exotic_space", "whitespace", "OGHAM SPACE MARK"), (0x2003, "exotic_space", "whitespace", "EM SPACE"), (0x202F, "exotic_space", "whitespace", "NARROW NO-BREAK SPACE"), (0x205F, "exotic_space", "whitespace", "MEDIUM MATHEMATICAL SPACE"), (0x3000, "exotic_space", "whitespace", "IDEOGRAPHIC SPACE"),
    (0x2018, "smart_quote", "typographic", "LEFT SINGLE QUOTATION MARK"), (0x201F, "smart_quote", "typographic", "DOUBLE HIGH-REVERSED-9 QUOTATION MARK"), (0x2010, "dash", "typographic", "HYPHEN"), (0x2014, "dash", "typographic", "EM DASH"), (0x2015, "dash", "typographic", "HORIZONTAL BAR"), (0x2026, "ellipsis", "typographic", "HORIZONTAL ELLIPSIS"),
    (0xFF21, "compatibility_variant", "typographic", "FULLWIDTH LATIN CAPITAL LETTER A"), (0x2460, "compatibility_variant", "typographic", "CIRCLED DIGIT ONE"), (0x212A, "compatibility_variant", "typographic", "KELVIN SIGN"), (0xFB01, "compatibility_variant", "typographic", "LATIN SMALL LIGATURE FI"), (0xB2, "compatibility_variant", "typographic", "SUPERSCRIPT TWO"),
    *[(cp, None, None, None) for cp in (0x9, 0xA, 0xD, 0x20, 0x41, 0x7E, 0xC4, 0xE9, 0x3B1, 0x430, 0x5D0, 0x627, 0x915, 0x3042, 0x4E00, 0xAC00, 0x1F600, 0x2212, 0x2190)],
]


def pinned_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C3, C5, by the kernel, and the category again by the ranges of C7."""

    @F.pandas_udf("struct<category:string,severity:string,name:string>")
    def info(cp: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None,) * 3 if (c := T.classify(int(x))) is None else (c.category, c.severity, c.name) for x in cp], columns=["category", "severity", "name"])

    p = _points(spark, CLASSES).withColumn("i", info("codepoint"))
    r = inspection.codepoint_ranges(spark).withColumnRenamed("category", "ranged")
    j = p.join(F.broadcast(r), p["codepoint"].between(r["lo"], r["hi"]), "left")
    return j.select(F.col("codepoint").cast("bigint").alias("codepoint"), "i.category", "i.severity", "i.name", "ranged")


SEVERITIES = [
    ("invisible", ["bidi_control", "control", "deprecated_format", "invisible_operator", "other_format", "script_invisible", "tag_character", "variation_selector", "zero_width"]),
    ("contextual", ["normalization_control", "private_use", "soft_hyphen", "word_joiner"]), ("whitespace", ["exotic_space"]),
    ("typographic", ["compatibility_variant", "dash", "ellipsis", "smart_quote"]), ("confusable", ["confusable", "mixed_script"]), ("whitespace invisible", ["bidi_control", "control", "deprecated_format", "exotic_space", "invisible_operator", "other_format", "script_invisible", "tag_character", "variation_selector", "zero_width"]),
    ("none", []),
]


def pinned_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    return spark.createDataFrame([(s, T.categories_for_severities(s.split())) for s, _ in SEVERITIES], "severities string, categories array<string>")


#: Character, emoji base, joining letter, joining family, barrier, script, ASCII form
TRAITS = [
    ("A", False, False, None, True, "Latin", None), ("é", False, False, None, True, "Latin", None), ("α", False, False, None, True, "Greek", None), ("а", False, False, None, True, "Cyrillic", None), ("א", False, False, "Hebrew", True, "Hebrew", None),
    ("ب", False, True, "Arabic", True, "Arabic", None), ("ء", False, False, "Arabic", True, "Arabic", None), ("क", False, False, "Devanagari", True, "Devanagari", None), ("्", False, False, "Devanagari", True, "Devanagari", None), ("ก", False, False, "Thai", True, "Thai", None),
    ("一", False, False, None, True, "Han", None), ("あ", False, False, None, True, "Hiragana", None), ("カ", False, False, None, True, "Katakana", None), ("가", False, False, None, True, "Hangul", None), ("Ա", False, False, None, True, "Armenian", None), ("ა", False, False, None, True, "Georgian", None),
    ("1", False, False, None, True, "Common", None), (" ", False, False, None, True, "Common", None), ("\U0001f468", True, False, None, True, "Common", None), ("❤", True, False, None, True, "Common", None),
    ("\U0001f3fd", False, False, None, False, "Common", None), ("‍", False, False, None, True, "Common", None), ("​", False, False, None, False, "Common", None), ("️", False, False, None, False, "Common", None),
    ("Ａ", False, False, None, True, "Common", "A"), ("①", False, False, None, True, "Common", "1"), ("⑴", False, False, None, True, "Common", "(1)"), ("ﬁ", False, False, None, True, "Common", "fi"), ("K", False, False, None, True, "Common", "K"),
]


def pinned_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6, C8-C11, C13."""
    joins = T.ranges("joins")
    rows = [(c, T.is_emoji_base(ord(c)), ord(c) in joins, T.joining_family(ord(c)), T.is_barrier(ord(c)), T.script_of(ord(c)), T.compatibility_ascii(ord(c))) for c, *_ in TRAITS]
    return spark.createDataFrame(rows, "ch string, emoji boolean, joins boolean, family string, barrier boolean, script string, folded string")


MIXES = [
    ("plain text", [], ["Latin"]), ("pаypal", ["Cyrillic", "Latin"], ["Cyrillic", "Latin"]), ("привет hello", [], ["Cyrillic", "Latin"]), ("αβb", ["Greek", "Latin"], ["Greek", "Latin"]), ("漢かカ", [], ["Han", "Hiragana", "Katakana"]),
    ("漢가", [], ["Han", "Hangul"]), ("а", [], ["Cyrillic"]), ("a1_б", ["Cyrillic", "Latin"], ["Cyrillic", "Latin"]), ("123", [], []),
]


def pinned_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of a text, and of the word that mixes some."""
    d = _texts(spark, MIXES)
    none = F.array().cast("array<string>")
    return d.select("text", F.coalesce(F.get(F.transform(U.suspicious_runs("text"), lambda r: r["scripts"]), F.lit(0)), none).alias("mixed"), U.scripts_in("text").alias("scripts"))


_MAN, _WOMAN, _BOY, _FLAG = "\U0001f468", "\U0001f469", "\U0001f466", "\U0001f3f4"
_TAGS = "".join(chr(0xE0000 + ord(c)) for c in "gbwls") + "\U000e007f"
#: Text, offset, whether the character there is content
BEARING = [
    (f"{_MAN}‍{_WOMAN}", 1, True), (f"{_MAN}\U0001f3fd‍{_WOMAN}", 2, True), (f"{_MAN}‍", 1, False), ("ad‍min", 2, False), (f"{_MAN}‍‍{_WOMAN}", 1, False),
    ("क्‍ष", 2, True), ("क‍ष", 1, False), ("نمی‌خواهم", 3, True), ("ء‌ب", 1, False), ("a‌b", 1, False),
    (f"{_FLAG}{_TAGS}", 1, True), (f"{_FLAG}{_TAGS}", 6, True), (f"{_FLAG}\U000e0061\U000e007f", 1, False), (_TAGS, 0, False),
    ("❤️", 1, True), ("1️⃣", 1, True), ("a️", 1, False), ("✈︎", 1, True), ("∩︀", 1, True), ("a︀", 1, False),
    ("漢\U000e0100", 1, True), ("a\U000e0100", 1, False), ("ᠠ᠋ᠡ", 1, True), ("a᠋", 1, False), ("ᠠ᠎", 1, False),
    ("가ᅟ가", 1, True), ("aᅟb", 1, False), ("ក឴ក", 1, True), ("a​b", 1, False), ("﻿a", 0, False),
]


def pinned_load_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L9."""
    at = F.pandas_udf(lambda text, offset: pd.Series([K.is_load_bearing(t, int(o)) for t, o in zip(text, offset)]), "boolean")
    d = spark.createDataFrame([r[:2] for r in BEARING], "text string, offset bigint")
    return d.select("text", "offset", at("text", "offset").alias("bearing"))


#: Text, offset, line, column, category, name, context
FOUND = [
    ("pass​word", 4, 1, 5, "zero_width", "ZERO WIDTH SPACE", "pass[U+200B]word"), ("a\nb‮c", 3, 2, 2, "bidi_control", "RIGHT-TO-LEFT OVERRIDE", "a\\nb[U+202E]c"),
    ("​​", 0, 1, 1, "zero_width", "ZERO WIDTH SPACE", "[U+200B]·"), ("​​", 1, 1, 2, "zero_width", "ZERO WIDTH SPACE", "·[U+200B]"),
    ("a\r\n \tb", 3, 2, 1, "exotic_space", "NO-BREAK SPACE", "a\\r\\n[U+00A0]\\tb"), ("x" * 30 + "—" + "y" * 30, 30, 1, 31, "dash", "EM DASH", "…" + "x" * 24 + "[U+2014]" + "y" * 24 + "…"),
    (f"{_MAN}‍{_WOMAN}​", 3, 1, 4, "zero_width", "ZERO WIDTH SPACE", f"{_MAN}‍{_WOMAN}[U+200B]"), ("pаy", 1, 1, 2, "mixed_script", "'pаy' mixes Cyrillic, Latin", "p[U+0430]y"),
]


def pinned_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, name and context of findings."""
    f = inspection.findings(_texts(spark, FOUND).withColumn("given", F.col("text")))
    return f.select(F.col("given").alias("text"), *[F.col(c).cast("bigint").alias(c) for c in ("offset", "line", "column")], "category", "name", "context")


#: Text, start, end, mode; None where there is no region
REGIONS = [
    ("see https://e.org/a, then", 4, 19, "literal"), ("(https://e.org/a_(b))", 1, 20, "literal"), ("mail me@x.org.", 5, 13, "literal"), ("write mailto:a@b.cd now", 6, 19, "literal"), ("go to www.e.org!", 6, 15, "literal"),
    ("file e.txt:3 there", 5, 12, "literal"), ("no regions here", None, None, None), ("a `code` b", 2, 8, "source"), ("a ``x ` y`` b", 2, 11, "source"), ("open ` only", None, None, None),
    ("```\nx\n```\n", 0, 10, "source"), ("````\n```\n````", 0, 13, "source"), ("~~~\nnever closed", 0, 16, "source"), ("t\n   ~~~ py\nx\n~~~~\nz", 2, 19, "source"), ("```a`b\nx", None, None, None), ("`https://e.org`", 0, 15, "source"),
]


def pinned_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4-X7."""
    r = _texts(spark, REGIONS).select("text", F.explode_outer(U.protected_regions("text")).alias("r"))
    return r.select("text", F.col("r.start").cast("bigint").alias("start"), F.col("r.end").cast("bigint").alias("end"), "r.mode")


_DASHED = "“a” — b…"
#: Text, profile, cleaned, removed, folded, normalized, status
CLEANED = [
    (_DASHED, "prose", _DASHED, 0, 0, 0, "complete"), (_DASHED, "code", '"a" - b...', 0, 4, 0, "complete"), ("a b　c", "prose", "a b c", 0, 2, 0, "complete"), ("pass​word", "prose", "password", 1, 0, 0, "complete"),
    ("﻿k—v\r\n​", "data", "k-v\n", 1, 1, 2, "complete"), ("﻿a\r\n", "data", "a\n", 0, 0, 2, "complete"), ("a\r​\nb", "data", "a\nb", 1, 0, 1, "complete"), ("a\r\n", "code", "a\r\n", 0, 0, 0, "complete"), ("﻿a", "prose", "a", 1, 0, 0, "complete"),
    ("say “x” in `“y”`", "prose", 'say “x” in `"y"`', 0, 2, 0, "complete"), ("x—y https://e.org/a—b c—d", "code", "x-y https://e.org/a—b c-d", 0, 2, 0, "complete"), ("```\n—\n```\n—", "prose", "```\n-\n```\n—", 0, 1, 0, "complete"),
    ("https://e.​org/’", "code", "https://e.org/’", 1, 0, 0, "complete"), ("`​“z”`", "data", '`"z"`', 1, 2, 0, "complete"), (f"{_MAN}‍{_WOMAN}", "code", f"{_MAN}‍{_WOMAN}", 0, 0, 0, "complete"),
    (f"{_MAN}​‍{_WOMAN}", "prose", f"{_MAN}‍{_WOMAN}", 1, 0, 0, "complete"), (f"{_MAN}‍‍{_WOMAN}", "prose", f"{_MAN}{_WOMAN}", 2, 0, 0, "complete"), ("hy­phen a⁠b", "code", "hy­phen a⁠b", 0, 0, 0, "complete"), ("", "prose", "", 0, 0, 0, "complete"), ("‹x› café", "code", "‹x› café", 0, 0, 0, "complete"),
]


def pinned_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning with regions; a second pass changes nothing."""
    d = _texts(spark, CLEANED, "profile").withColumn("given", F.col("text"))
    once = inspection.clean(d, F.col("profile")).drop("transformed", "changed")
    again = inspection.clean(once.select("given", "profile", "text", "removed", "folded", "normalized", "parse_status").withColumnsRenamed({"removed": "r", "folded": "f", "normalized": "n", "parse_status": "status"}), F.col("profile"))
    return again.select(F.col("given").alias("given"), "profile", F.col("text").alias("cleaned"), F.col("r").alias("removed"), F.col("f").alias("folded"), F.col("n").alias("normalized"), "status", (~F.col("changed")).alias("stable"))


SHOWN = [("plain\ttext\n", "plain\\x09text\\x0a"), ("\x1b[31mred", "\\x1b[31mred"), ("a‮b", "a\\u202eb"), ("\x9b", "\\x9b"), ("⁦x⁩", "\\u2066x\\u2069"), ("café 一", "café 一"), ("؜‎", "\\u061c\\u200e")]


def pinned_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls never reach a terminal."""
    return _texts(spark, SHOWN).select("text", U.terminal_safe("text").alias("safe"))


def _box(kind: bytes, body: bytes) -> bytes:
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def _described(uuid: bytes, label: bytes, *children: bytes) -> bytes:
    return _box(b"jumb", _box(b"jumd", uuid + b"\x03" + label + b"\0") + b"".join(children))


_ISO = bytes.fromhex("00110010800000aa00389b71")
_STORE = _described(b"c2pa" + _ISO, b"c2pa", _described(b"c2ma" + _ISO, b"urn:c2pa:1", _box(b"cbor", b"\xa0")))
_ZIPPED = S.docx("T")


def _cases() -> dict[str, bytes]:
    png, chunk, jpeg, segment = S.png, S.png_chunk, S.jpeg, S.jpeg_segment
    return {
        "png plain": png(), "png text": png("t"), "png cut": png("t")[:-3], "png tail": png("t") + b"!", "png crc": png("t")[:45] + b"\xff" + png("t")[46:], "png without data": png("t", idat=0), "png two headers": png(None, chunk(b"IHDR", b"")), "png unknown critical": png(None, chunk(b"ABCD", b"")),
        "png compressed": png(None, chunk(b"zTXt", b"Z\0\0" + zlib.compress(b"words"))), "png international": png(None, chunk(b"iTXt", b"I\0\0\0en\0t\0" + "é".encode())), "png bad text": png(None, chunk(b"zTXt", b"B\0\1x")), "png bomb": png(None, chunk(b"zTXt", b"B\0\0" + zlib.compress(bytes(24 << 20)))), "png exif": png(None, chunk(b"eXIf", b"abc")),
        "png provenance": png(None, chunk(b"caBX", _STORE)), "png two stores": png(None, chunk(b"caBX", _STORE), chunk(b"caBX", _STORE)), "png false store": png(None, chunk(b"caBX", _box(b"free", b""))),
        "jpeg plain": jpeg(), "jpeg comment": jpeg("c"), "jpeg cut": jpeg()[:-2], "jpeg no frame": b"\xff\xd8\xff\xd9", "jpeg short segment": b"\xff\xd8\xff\xe1\0\1", "jpeg exif": jpeg(None, segment(0xE1, b"Exif\0\0abc")), "jpeg provenance": jpeg(None, segment(0xEB, b"JP\0\1\0\0\0\1" + _STORE[:40]), segment(0xEB, b"JP\0\1\0\0\0\2" + _STORE[40:])), "jpeg broken sequence": jpeg(None, segment(0xEB, b"JP\0\1\0\0\0\1jumb"), segment(0xEB, b"JP\0\1\0\0\0\3x")),
        "svg plain": b"<svg/>", "svg title": S.svg("t"), "svg entity": b'<!DOCTYPE s [<!ENTITY a "b">]><svg>&a;</svg>', "svg external": b'<!DOCTYPE s [<!ENTITY a SYSTEM "file:///x">]><svg>&a;</svg>', "svg doctype": b'<!DOCTYPE svg PUBLIC "-//W3C//DTD SVG 1.1//EN" "http://www.w3.org/x.dtd"><svg/>', "svg open": b"<svg>", "svg deep": b"<svg>" * 300 + b"</svg>" * 300, "svg wide": "<?xml version='1.0' encoding='utf-16'?><svg><title>w</title></svg>".encode("utf-16"),
        "office": _ZIPPED, "office cut": b"PK\3\4", "office entity": S.docx("T", **{"docProps/app.xml": b"<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>"}), "office broken part": S.docx("T", **{"docProps/app.xml": b"<x>"}), "office bomb": S.docx("T", **{"docProps/custom.xml": bytes(32 << 20)}), "office other zip": _ZIPPED.replace(b"[Content_Types].xml", b"[Content_Typos].xml"),
        "pdf": S.pdf("T"), "pdf encrypted": b"%PDF-1 /Encrypt 1", "plain": b"words", "empty": b"",
    }


#: Case, format, status, substantive keys, whether a store was parsed, status of a request to clean, whether it is a sound ZIP file
CONTAINERS = [
    ("png plain", "png", "complete", 0, False, "complete"), ("png text", "png", "complete", 1, False, "refused"), ("png cut", "png", "malformed", 1, False, "refused"), ("png tail", "png", "malformed", 1, False, "refused"), ("png crc", "png", "malformed", 0, False, "refused"), ("png without data", "png", "malformed", 1, False, "refused"), ("png two headers", "png", "malformed", 0, False, "refused"), ("png unknown critical", "png", "malformed", 0, False, "refused"),
    ("png compressed", "png", "complete", 1, False, "refused"), ("png international", "png", "complete", 1, False, "refused"), ("png bad text", "png", "partial", 1, False, "refused"), ("png bomb", "png", "resource_limit", 1, False, "refused"), ("png exif", "png", "complete", 1, False, "refused"),
    ("png provenance", "png", "complete", 3, True, "refused"), ("png two stores", "png", "partial", 3, True, "refused"), ("png false store", "png", "complete", 2, False, "refused"),
    ("jpeg plain", "jpeg", "complete", 0, False, "complete"), ("jpeg comment", "jpeg", "complete", 1, False, "refused"), ("jpeg cut", "jpeg", "malformed", 0, False, "refused"), ("jpeg no frame", "jpeg", "malformed", 0, False, "refused"), ("jpeg short segment", "jpeg", "malformed", 0, False, "refused"), ("jpeg exif", "jpeg", "complete", 1, False, "refused"), ("jpeg provenance", "jpeg", "complete", 5, True, "refused"), ("jpeg broken sequence", "jpeg", "complete", 4, False, "refused"),
    ("svg plain", "svg", "complete", 0, False, "unsupported"), ("svg title", "svg", "complete", 1, False, "unsupported"), ("svg entity", "svg", "refused", 0, False, "unsupported"), ("svg external", "svg", "refused", 0, False, "unsupported"), ("svg doctype", "svg", "complete", 0, False, "unsupported"), ("svg open", "svg", "malformed", 0, False, "unsupported"), ("svg deep", "svg", "resource_limit", 0, False, "unsupported"), ("svg wide", "svg", "complete", 1, False, "unsupported"),
    ("office", "office", "complete", 2, False, "unsupported"), ("office cut", "office", "malformed", 0, False, "unsupported"), ("office entity", "office", "refused", 2, False, "unsupported"), ("office broken part", "office", "partial", 2, False, "unsupported"), ("office bomb", "office", "resource_limit", 2, False, "unsupported"), ("office other zip", "office", "unsupported", 0, False, "unsupported"),
    ("pdf", "pdf", "partial", 2, False, "unsupported"), ("pdf encrypted", "pdf", "malformed", 0, False, "unsupported"), ("plain", None, None, 0, False, "unsupported"), ("empty", None, None, 0, False, "unsupported"),
]


def pinned_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound, broken, hostile and signed containers, and what a request to clean them gives."""
    names = {"svg entity": "x.svg", "svg external": "x.svg", "svg doctype": "x.svg"}
    d = spark.createDataFrame([(k, bytearray(v), names.get(k)) for k, v in _cases().items()], "case string, content binary, path string")
    d = d.select("case", "content", U.parse_metadata("content", "path").alias("m"))
    meta = F.coalesce("m.metadata", F.create_map().cast("map<string,string>"))
    d = d.select("case", "content", "m.fmt", meta.alias("metadata"), U.clean_container("content", F.col("m.fmt")).alias("c"))
    status = F.try_element_at("metadata", F.concat("fmt", F.lit(".parse_status")))
    parsed = F.exists(F.map_keys("metadata"), lambda k: k.endswith("c2pa_manifest_store_structurally_parsed"))
    return d.select("case", "fmt", status.alias("parse_status"), F.size(C.substantive(F.col("metadata"))).cast("bigint").alias("keys"), parsed.alias("store"), F.col("c.parse_status").alias("clean_status"), U.is_valid_zip("content").alias("zip"))


LIMITS = [("MEMBER_LIMIT", 8 << 20), ("CONTAINER_LIMIT", 256 << 20), ("ITEM_LIMIT", 10_000), ("METADATA_LIMIT", 16 << 20), ("INFLATED_LIMIT", 16 << 20), ("XML_LIMIT", 2 << 20)]


def pinned_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits of the readers and of a report."""
    rows = [(n, getattr(containers, n)) for n, _ in LIMITS] + [("text", T.MAX_TEXT), ("findings", T.MAX_FINDINGS)]
    return spark.createDataFrame(rows, "name string, bytes bigint")


#: A tree of files, an order, the exit code, and the text of the cleaned file afterwards
ORDERS = [
    ("inspect", ["inspect", "-r", "d"], 0, "x​—\n"), ("inspect, strict", ["inspect", "--fail-on", "invisible", "d/a.md"], 1, "x​—\n"), ("inspect, a folder", ["inspect", "d"], 2, "x​—\n"), ("inspect, nothing there", ["inspect", "d/none"], 2, "x​—\n"), ("inspect, a link", ["inspect", "-r", "l"], 2, "x​—\n"),
    ("check", ["clean", "--check", "-r", "d"], 1, "x​—\n"), ("check, clean", ["clean", "--check", "d/c.txt"], 0, "x​—\n"), ("dry run", ["clean", "--dry-run", "-r", "d"], 0, "x​—\n"), ("output", ["clean", "d/a.md"], 0, "x​—\n"), ("output of several", ["clean", "d/a.md", "d/c.txt"], 2, "x​—\n"),
    ("in place", ["clean", "-i", "-r", "d"], 0, "x—\n"), ("in place, as code", ["clean", "-i", "--profile", "code", "d/a.md"], 0, "x-\n"), ("with backup", ["clean", "-i", "--backup", "d/a.md"], 0, "x—\n"), ("backup there", ["clean", "-i", "--backup", "d/b.py"], 2, "x​—\n"), ("backup over", ["clean", "-i", "--backup", "--overwrite-backup", "d/b.py"], 0, "x\u200b—\n"), ("backup is a target", ["clean", "-i", "--backup", "--overwrite-backup", "-r", "d"], 2, "x\u200b—\n"), ("container", ["clean", "-i", "p.pdf"], 2, "x​—\n"),
]


def _ordered(args: list[str]) -> tuple[int, str, int, bool]:
    """Exit code, the text of a.md, how many backups there are, and whether any temporary file is left, in a fresh tree."""
    import contextlib
    import io
    import os
    import tempfile
    from pathlib import Path

    from quillsift import cli

    with tempfile.TemporaryDirectory() as top:
        root = Path(top)
        (root / "d").mkdir()
        (root / "l").mkdir()
        (root / "d" / "a.md").write_text("x\u200b\u2014\n", encoding="utf-8")
        (root / "d" / "b.py").write_text("s = \u201cq\u201d\n", encoding="utf-8")
        (root / "d" / "b.py.bak").write_text("old\n")
        (root / "d" / "c.txt").write_text("fine\n")
        (root / "p.pdf").write_bytes(S.pdf("t"))
        os.symlink(root / "d" / "a.md", root / "l" / "k")
        out = io.TextIOWrapper(io.BytesIO(), encoding="utf-8")
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(out):
            code = cli.main([str(root / a) if a.split("/")[0] in ("d", "l", "p.pdf") else a for a in args])
        left = [p.name for p in root.rglob("*")]
        return code, (root / "d" / "a.md").read_text(encoding="utf-8"), sum(n.endswith(".bak") for n in left), any(n.startswith(".") for n in left)


def pinned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders of the command line do to a tree of files, each in a tree of its own."""

    @F.pandas_udf("struct<code:bigint,text:string,backups:bigint,litter:boolean>")
    def run(args: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_ordered(list(a)) for a in args], columns=["code", "text", "backups", "litter"])

    d = spark.createDataFrame([r[:2] for r in ORDERS], "name string, args array<string>")
    return d.select("name", run("args").alias("r")).select("name", "r.*")


AUDITED = [("correctness", "contraband", 17), ("correctness", "fidelity", 11), ("correctness", "load-bearing", 12), ("policy", "confusables", 3), ("policy", "context-dependent", 4), ("policy", "typography", 5), ("policy", "whitespace", 2)]


def pinned_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases a group has, and how many our cleaner and one that does nothing pass."""
    from quillsift.operators import audit

    got = audit.by_group(audit.run(audit.corpus(spark), {"own": audit.own, "nothing": audit.nothing}))
    return got.groupBy("tier", F.col("grp").alias("group")).agg(F.max("cases").alias("cases"), F.sum(F.when(F.col("tool") == "own", F.col("passed"))).alias("own"), F.sum(F.when(F.col("tool") == "nothing", F.col("passed"))).alias("nothing"))


PINS = {
    pinned_orders: lambda: values([(n, c, t, 2 if n == "with backup" else 1, False) for n, _, c, t in ORDERS], "name", "code", "text", "backups", "litter"),
    pinned_audit: lambda: values([(t, g, n, n, {"contraband": 0, "whitespace": 0, "typography": 4}.get(g, n)) for t, g, n in AUDITED], "tier", "group", "cases", "own", "nothing"),
    pinned_classes: lambda: values([(*r, r[1]) for r in CLASSES], "codepoint", "category", "severity", "name", "ranged"),
    pinned_severities: lambda: values(SEVERITIES, "severities", "categories"),
    pinned_traits: lambda: values(TRAITS, "ch", "emoji", "joins", "family", "barrier", "script", "folded"),
    pinned_mixes: lambda: values(MIXES, "text", "mixed", "scripts"),
    pinned_load_bearing: lambda: values(BEARING, "text", "offset", "bearing"),
    pinned_findings: lambda: values(FOUND, "text", "offset", "line", "column", "category", "name", "context"),
    pinned_regions: lambda: values(REGIONS, "text", "start", "end", "mode"),
    pinned_cleaning: lambda: values([(*r, True) for r in CLEANED], "given", "profile", "cleaned", "removed", "folded", "normalized", "status", "stable"),
    pinned_display: lambda: values(SHOWN, "text", "safe"),
    pinned_containers: lambda: values([(*r, r[0].startswith("office") and r[0] != "office cut") for r in CONTAINERS], "case", "fmt", "parse_status", "keys", "store", "clean_status", "zip"),
    pinned_limits: lambda: values([*LIMITS, ("text", 1_000_000), ("findings", 10_000)], "name", "bytes"),
}
