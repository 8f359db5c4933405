"""Hidden characters put into the driver's clean texts, by id, in one expression both engines read."""

from __future__ import annotations

FAMILY = "\U0001f468‍\U0001f469‍\U0001f466"
SCOTLAND = "\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in "gbsct") + "\U000e007f"
DEVANAGARI = "क्‍ष"
PERSIAN = "نمی‌خواهم"

CASES = (
    "replace({t}, ' a', ' ​a')",
    "replace({t}, ' e', ' e')",
    "replace({t}, 'e', 'е')",
    f"{{t}} || ' {FAMILY} and {FAMILY}'",
    "'﻿' || {t}",
    "replace({t}, 'th', 't‍h')",
    f"{{t}} || ' {DEVANAGARI} क‍ष'",
    f"replace({{t}}, ' i', ' {PERSIAN} i') || ' ء‌ب'",
    f"{{t}} || ' {SCOTLAND} \U0001f3f4\U000e0061\U000e007f {SCOTLAND}\U000e0041'",
    "{t} || ' ❤️ 1️⃣ a️ ✈︎'",
    "replace(replace({t}, ', ', ' — '), ' o', ' “o”…')",
    "replace({t}, 'T', 'Ｔ') || ' ①K⑴'",
    "replace({t}, ' s', ' ‮s‬')",
    "replace({t}, chr(10), chr(13) || chr(10))",
    "replace({t}, 'on', 'o­n') || ' a⁠b͏c '",
    "{t} || ' 가ᅟ가 aᅟb ក឴ក'",
    "{t} || ' ᠠ᠋ᠡ a᠋ ᠠ᠎'",
    "{t} || ' 漢\U000e0100 a\U000e0100'",
    "{t} || ' ∩︀ a︀'",
    "replace({t}, ' r', chr(7) || ' r') || chr(127)",
    f"{{t}} || ' \U0001f468​‍\U0001f469' || '{FAMILY}‍'",
    "{t} || ' \U0001f468\U0001f3fd‍\U0001f469 ⁪⁢￹'",
    "{t} || ' 漢かカ pαypal привет аb_1'",
    "{t}",
)


def dirty(text: str = "text", key: str = "doc_id") -> str:
    """SQL for both engines: every text gets the injection of its id; a null id gets none."""
    arms = " ".join(f"WHEN {i} THEN {case.format(t=text)}" for i, case in enumerate(CASES))
    return f"CASE {key} % {len(CASES)} {arms} ELSE {text} END"
