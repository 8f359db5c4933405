import math
import random
import re

import numpy as np

from conftest_llm import make, prose
from quillsift.llm import secret_scan as S


def brute_battery(s, alphabet):
    n, k = len(s), len(alphabet)
    x = [alphabet.index(c) for c in s]
    x2 = sum((x.count(i) - n / k) ** 2 / (n / k) for i in range(k))
    chi = ((x2 / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / (2 / (9 * (k - 1))) ** 0.5
    high = [v >= (k + 1) // 2 for v in x]
    a = sum(high)
    b = n - a
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    mean = 1 + 2 * a * b / n
    return chi, (runs - mean) / ((mean - 1) * (mean - 2) / (n - 1)) ** 0.5


def test_battery_against_definitions():
    rng = random.Random(1)
    for kind in ("hex", "base62"):
        alphabet = S.ALPHABETS[kind]
        s = "".join(rng.choices(alphabet, k=40))
        chi, runs, _, _ = S.battery(np.array([[alphabet.index(c) for c in s]]), len(alphabet))
        want = brute_battery(s, alphabet)
        assert abs(chi[0] - want[0]) < 1e-9 and abs(runs[0] - want[1]) < 1e-9


def test_random_strings_pass_at_their_level():
    rng = np.random.default_rng(2)
    p = S.random_p(S.battery(rng.integers(0, 16, (2000, 40)), 16)[3])
    assert 0.0 <= (p < 0.05).mean() < 0.1 and 0.4 < p.mean() < 0.6
    assert S.random_p(S.battery(np.zeros((1, 40), int), 16)[3])[0] < 1e-6
    assert S.random_p(S.battery(np.tile(np.arange(16), (1, 3)), 16)[3])[0] < 1e-3


def test_encodings():
    assert [S.encoding_of(t) for t in ("0123456789", "deadbeef01", "DEADBEEF01", "ABCDZ234", "abcz09", "aZ09", "aZ+/", "aZ-_", "a+_", "words")] == [None, "hex", "hex_upper", "base32", "base36", "base62", "base64", "base64_url", None, "lower"]


def test_discoveries_are_benjamini_hochberg():
    rng = random.Random(3)
    p = [10 ** -(rng.random() * 6) for _ in range(20)] + [rng.random() for _ in range(200)]
    bins = [min(int(-np.log10(x) * 20), 300) for x in p]
    upper = [10 ** (-b / 20) for b in bins]
    order = sorted(upper)
    passed = [x for i, x in enumerate(order) if x <= 0.05 * (sum(y <= x for y in order)) / len(order)]
    got = S.discoveries([("hex", 1, b, bins.count(b)) for b in set(bins)], 0.05, 20).get(("hex", 1))
    assert {b for b in bins if 10 ** (-b / 20) <= max(passed)} == {b for b in bins if b >= got}


def test_finds_keys_and_leaves_words(spark):
    rng = random.Random(4)
    rows, planted = [], set()
    syllables = ["the", "er", "ing", "ation", "on", "st", "re", "and", "en"]
    for i in range(200):
        t = " ".join("".join(rng.choices(syllables, k=rng.choice([1, 2, 3, 7, 9]))) for _ in range(60)) + " é "
        if i % 4 == 0:
            key = "".join(rng.choices("0123456789abcdef", k=40)) if i % 8 else "".join(rng.choices(S.ALPHABETS["base62"], k=48))
            planted.add((i, len(t) + 4, len(key)))
            t += f'k="{key}" 4556737586899855 end'
        rows.append((i, t))
    got = {(r.doc_id, r.start - 1 + 1, r.length) for r in S.scan(make(spark, rows)).collect()}
    want = {(i, at - 1, n) for i, at, n in planted}
    assert len(got & want) >= 0.8 * len(want) and len(got - want) <= 0.1 * len(got)
    for r in S.scan(make(spark, rows)).limit(3).collect():
        assert re.fullmatch(r"[0-9A-Za-z]+", dict(rows)[r.doc_id][r.start : r.start + r.length])


def brute_scan(rows, q=0.05, alpha=1e-3):
    """The whole scan in plain loops, but for the simulated null."""
    found, size = [], len(S.SYMBOLS)
    pairs = np.zeros(size * size, int)
    for d, t in rows:
        for a, b in zip(t, t[1:]):
            if a in S.SYMBOLS and b in S.SYMBOLS:
                pairs[S.SYMBOLS.index(a) * size + S.SYMBOLS.index(b)] += 1
        spans = [m.span() for m in re.finditer("[0-9A-Za-z]{16,}", t)]
        for m in re.finditer("[0-9A-Za-z+/_-]{20,}", t):
            if not m.group().isalnum():
                inner = [m.span()] if S.encoding_of(m.group()) else [(m.start() + x.start(), m.start() + x.end()) for rx in ("[0-9A-Za-z+/]{20,}", "[0-9A-Za-z_-]{20,}") for x in re.finditer(rx, m.group())]
                spans += [(a, b) for a, b in inner if not t[a:b].isalnum()]
        for a, b in spans:
            if kind := S.encoding_of(t[a:b]):
                s, alphabet = t[a:b], S.ALPHABETS[kind]
                n, x = len(s), [alphabet.index(c) for c in s]
                high = [v >= (len(alphabet) + 1) // 2 for v in x]
                chi, runs = brute_battery(s, alphabet) if 1 < sum(high) < n - 1 else (None, None)
                if runs is None:
                    *_, fisher = S.battery(np.array([x]), len(alphabet))
                    found.append((d, a, n, kind, float(fisher[0])))
                    continue
                mean = sum(x) / n
                power = sum((v - mean) ** 2 for v in x)
                serial = (sum((u - mean) * (v - mean) for u, v in zip(x, x[1:])) / power + 1 / n) * n**0.5
                tail = lambda z: 0.5 * math.erfc(z / 2**0.5)
                found.append((d, a, n, kind, -2 * sum(math.log(p) for p in (tail(chi), 2 * tail(abs(runs)), 2 * tail(abs(serial))))))
    null, strata = S.text_null(pairs), {}
    for d, a, n, kind, fisher in found:
        at = math.log(min(n, int(S.GRID[-1])))
        mean, dev = (float(np.interp(at, np.log(S.GRID), x)) for x in null[kind])
        p = 0.5 * math.erfc((mean - math.log(fisher + 1e-9)) / dev / 2**0.5)
        p_bin = 10 ** (-math.floor(-math.log10(max(p, 1e-15)) * 20) / 20)  # the largest p of its bin
        strata.setdefault((kind, sum(n >= g for g in S.GRID)), []).append((p_bin, d, a, n, fisher))
    out = set()
    for members in strata.values():
        passed = [p for p, *_ in members if p <= q * sum(x[0] <= p for x in members) / len(members)]
        out |= {(d, a, n) for p, d, a, n, f in members if passed and p <= max(passed) and math.exp(-f / 2) * (1 + f / 2 + f * f / 8) >= alpha}
    return out


def test_whole_scan_against_brute_force(spark):
    rng = random.Random(8)
    syllables = ["the", "er", "ing", "ation", "on", "st", "re", "and", "en", "/", "-"]
    rows = []
    for i in range(120):
        t = " ".join("".join(rng.choices(syllables, k=rng.choice([2, 3, 7, 9, 12]))) for _ in range(40))
        key = "".join(rng.choices(S.ALPHABETS[rng.choice(["hex", "base62", "base64", "base64_url"])], k=rng.choice([24, 40, 64])))
        rows.append((i, t + [f" {key} \u00e9", f" /t/{key}_x", "", " 1234567890123456789"][i % 4]))
    got = {(r.doc_id, r.start, r.length) for r in S.scan(make(spark, rows)).collect()}
    assert got == brute_scan(rows) and len(got) > 20


def test_no_secret_leaves_its_task(spark):
    key = "f3a9c1d27b5e8064f1d39ab2c6e7504889aa01bc"
    assert not [r for r in S.candidates(make(spark, [(1, f"k={key}")])).collect() if key in str(r.asDict())]


def test_odd_rows(spark, odd, empty):
    assert S.scan(empty).count() == 0
    assert all(r.length >= 16 for r in S.scan(odd).collect())
    key = "f3a9c1d27b5e8064f1d39ab2c6e7504889aa01bc"
    d = make(spark, [(None, f"{key} {key}"), (1, key), (1, key), *((i, prose(random.Random(i), 400)) for i in range(20))])
    assert S.scan(d, q=0.5).count() in (0, 4)
