"""Kernels: classification, context, scripts, regions, cleaning and its invariants."""

import random
import time

import pytest

from quillsift.functions import kernels as K
from quillsift.functions import taxonomy as T

ZWSP, VS16, BOM = "​", "️", "﻿"
FLAG = "\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in "gbsct") + "\U000e007f"
FAMILY = "\U0001f468‍\U0001f469‍\U0001f466"


@pytest.mark.parametrize(
    ("cp", "category"),
    [
        (0x200B, "zero_width"), (0xFEFF, "zero_width"), (0x2060, "word_joiner"), (0x202E, "bidi_control"), (0x2062, "invisible_operator"), (0x206C, "deprecated_format"),
        (0xE0041, "tag_character"), (0xFE0F, "variation_selector"), (0xAD, "soft_hyphen"), (0x34F, "normalization_control"), (0x3164, None), (0x115F, "script_invisible"),
        (0xA0, "exotic_space"), (0x201C, "smart_quote"), (0x2014, "dash"), (0x2026, "ellipsis"), (0xFF21, "compatibility_variant"), (0x212A, "compatibility_variant"),
        (0x85, "control"), (0x7, "control"), (0xE000, "private_use"), (0x61C, "other_format"), (0x2028, None), (0x9, None), (0x41, None), (0x437, None), (0x180F, None), (0x2065, None),
    ],
)
def test_category(cp, category):
    assert T.category(cp) == category


def test_every_category_has_a_ranked_severity():
    assert len(T.CATEGORIES) == 20 and set(T.CATEGORIES.values()) == set(T.RANKS)
    assert T.classify(0x200B).escape == "U+200B" and T.classify(0x85).name == "<control>"
    assert T.categories_for_severities(["whitespace"]) == ["exotic_space"]


@pytest.mark.parametrize("text", [FLAG, FAMILY, "❤" + VS16, "1" + VS16 + "⃣", "क्‍ष", "نمی‌خواهم", "漢\U000e0100", "∩︀", "ᠠ᠋", "가ᅟ가"])
@pytest.mark.parametrize("profile", K.PROFILES)
def test_content_stays(text, profile):
    assert K.clean(f"a {text} b", profile).cleaned == f"a {text} b"
    assert list(K.findings(text)) == []


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ("a‍b", "ab"), ("a" + VS16, "a"), ("x​y", "xy"), ("\U0001f3f4\U000e0061\U000e007f", "\U0001f3f4"), (FLAG[:-1], "\U0001f3f4"), (FLAG + "\U000e0041", "\U0001f3f4"),
        ("क‍ष", "कष"), ("a᠋", "a"), ("‮abc", "abc"), ("a\x07b", "ab"), (FAMILY.replace("‍", "​‍", 1), FAMILY),
        ("ء‌ب", "ءب"), ("\U0001f468‍‍\U0001f469", "\U0001f468\U0001f469"), ("aᅟb", "ab"), ("\U0001f468\U0001f3fd‍\U0001f469", "\U0001f468\U0001f3fd‍\U0001f469"),
    ],
)
def test_hidden_goes(text, left):
    assert K.clean(text).cleaned == left


@pytest.mark.parametrize("text", ["a͏b", "a­b", "a⁠b", "ab"])
def test_contextual_is_reported_and_stays(text):
    assert K.clean(text, "code").cleaned == text
    assert [f.severity for f in K.findings(text)] == ["contextual"]


def test_positions_and_context():
    f = list(K.findings("ab\ncd" + ZWSP + "\r\n‮" + ZWSP))
    assert [(x.offset, x.line, x.column) for x in f] == [(5, 2, 3), (8, 3, 1), (9, 3, 2)]
    assert f[0].context == "ab\\ncd[U+200B]\\r\\n··"
    assert K.context_of("x" * 100, "x", 50, 2) == "…xx[U+0078]xx…"


def test_runs():
    r = K.suspicious_runs("pаypal привет 漢かカ привеt")
    assert [(x.offset, x.scripts, x.suspicious_offsets) for x in r] == [(1, ("Cyrillic", "Latin"), (1,)), (23, ("Cyrillic", "Latin"), (23,))]
    assert r[0].description == "'pаypal' mixes Cyrillic, Latin"
    assert K.suspicious_runs("аb")[0].suspicious_offsets == (0,)  # Latin wins a tie
    assert K.suspicious_runs("a.б") == []


def test_fold_confusables():
    assert K.fold_confusables("Ｐаypal привет ①")[0] == "Paypal привет 1"


@pytest.mark.parametrize("url", ["example.com/a—b", "www.a.org/’x", "https://e.org/it’s", "a.b@c.org", "mailto:x–y", "https://e.org/a_(b—c)"])
def test_addresses_stay(url):
    assert url in K.clean(f"see {url}, and —", "code").cleaned


@pytest.mark.parametrize(("text", "needle"), [("``a — b``", "a - b"), ("````\n“x”\n```\n—\n````\n", '"x"\n```\n-'), ("~~~\n— x", "- x"), ("` — `` — `", "- `` -")])
def test_code_regions_fold_in_prose(text, needle):
    assert needle in K.clean(text).cleaned


def test_backtick_in_an_info_string_opens_nothing():
    assert K.fences("``` a`b\n—\n") == []
    assert K.clean("— x").cleaned == "— x"


@pytest.mark.parametrize(
    ("text", "counts"),
    [(BOM + "a—b\r\n" + ZWSP, (1, 1, 2)), (BOM + "a\r\n", (0, 0, 2)), ("a\r" + ZWSP + "\nb", (1, 0, 1)), ("…", (0, 1, 0)), ("‘︀", (1, 1, 0)), ("　︀", (1, 1, 0))],
)
def test_counters_under_data(text, counts):
    c = K.clean(text, "data")
    assert (c.removed, c.folded, c.normalized) == counts


def test_limits():
    assert K.inspect("abcde" + ZWSP, max_text=4).parse_status == "resource_limit"
    got = K.inspect(ZWSP * 6, max_findings=3)
    assert len(got.findings) == 3 and got.parse_status == "resource_limit"
    assert K.clean(ZWSP * 6, max_text=4).cleaned == ZWSP * 6


ALPHABET = [*"ab Z.\n", ZWSP, "‮", "\xa0", "—", "“", "’", "…", BOM, "\xad", "\U000e0041", VS16, "❤", "`", "```", "http://", "⁠", "　", "'", "︀", "\r", "‍", "\U0001f468"]


@pytest.mark.parametrize(("seed", "longest"), [(1, 60), (2, 140), (3, 100)])
@pytest.mark.parametrize("profile", K.PROFILES)
def test_fuzz(seed, longest, profile):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(longest)))
        once = K.clean(text, profile).cleaned
        assert K.clean(once, profile).cleaned == once
        keep = K.load_bearing(once)
        assert all(i in keep for i, ch in enumerate(once) if T.is_invisible(ord(ch)))


def _best(fn, text):
    times = []
    for _ in range(2):
        t = time.perf_counter()
        fn(text)
        times.append(time.perf_counter() - t)
    return min(times)


@pytest.mark.parametrize("unit", ["‍", "‌", "\U000e0041", "\U000e0100", "ᅟ", "​‍", "a.b/"])
def test_linear(unit):
    work = lambda t: (K.inspect(t), K.clean(t))
    small, large = _best(work, "x" + unit * 1000), _best(work, "x" + unit * 4000)
    assert large < 8 * small + 0.15 and large < 3


def test_terminal_safe():
    assert K.terminal_safe("a\x1b[0m‮؜é") == "a\\x1b[0m\\u202e\\u061cé"


def test_texts_whose_scripts_are_no_mix_are_not_searched_for_words(monkeypatch):
    import random

    rng = random.Random(8)
    words = [("".join(rng.choice("abTеппαωüé漢かカ한ع1_ं") for _ in range(rng.randrange(1, 5)))) for _ in range(4000)]
    texts = [" ".join(rng.choice(words[at : at + 6]) for _ in range(4)) for at in range(0, 3900)]
    got = [K.suspicious_runs(t) for t in texts]
    with monkeypatch.context() as m:
        m.setattr(K, "_may_mix", lambda text: True)
        assert [K.suspicious_runs(t) for t in texts] == got
    assert any(got) and not all(got)
    monkeypatch.setattr(K, "_word", None)
    assert K.suspicious_runs("Grüße aus Köln — “ça va” ①") == [] and K.suspicious_runs("привет мир 1") == []
