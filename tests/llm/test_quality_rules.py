import math
import random
import statistics
from collections import Counter

from conftest_llm import make, prose
from quillsift.llm import pieces
from quillsift.llm import quality_rules as Q


def brute(text):
    words = (text or "").split()
    out = []
    for path in (pieces.DEFAULT_MODEL, pieces.SECOND_MODEL):
        v = pieces.word_table(path).vocabulary
        ids = [i for w in words for i in v.each([w])[0]]
        n = max(len(ids), 1)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        out.append((len(ids), sum(map(len, words)) / n, sum(bool(v.is_byte[i]) for i in ids) / n, entropy / math.log2(n) if n > 1 else 1.0))
    return out


def test_metrics_against_brute_force(spark):
    texts = ["The quick brown fox jumps.", "", None, "   ", "日本語 ᚠᚢᚦ ☃☃☃", "aaa aaa aaa", "é " * 50, "x"]
    got = {r.doc_id: r for r in Q.measure(make(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        (n, cpt, share, entropy), (_, cpt2, share2, _) = brute(t)
        r = got[i]
        assert r.n_tokens == n
        for have, want in ((r.chars_per_token, cpt), (r.byte_share, share), (r.token_entropy, entropy), (r.chars_per_token_2, cpt2), (r.byte_share_2, share2)):
            assert math.isclose(have, want, abs_tol=1e-9)


def quantile(values, q):
    v = sorted(values)
    at = q * (len(v) - 1)
    lo = math.floor(at)
    return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)


def test_decisions_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(30, 60), 50), "xx") for i in range(150)] + [(200 + i, "$%&# " * 40, "xx") for i in range(5)] + [(300 + i, "same same same " * 50, "xx") for i in range(5)]
    docs = make(spark, rows)
    got = {r.doc_id: r for r in Q.quality_rules(docs, min_group=20).collect()}
    step = lambda x: math.floor(x * 2000 + 0.5) / 2000
    groups = {}
    for r in got.values():
        groups.setdefault(r.size_class, []).append(r)
    for members in groups.values():
        fences = {}
        for f, least, *_ in Q.RULES:
            v = [step(getattr(r, f)) for r in members]
            a, b = quantile(v, 0.25), quantile(v, 0.75)
            wide = 3 * max(b - a, least)
            fences[f] = (a - wide, b + wide)
        for r in members:
            ok = all((f.startswith("byte_share") or lo <= getattr(r, f)) and getattr(r, f) <= hi for f, (lo, hi) in fences.items())
            assert r.keep == ok
    assert not any(got[i].keep for i in range(200, 205)) and not any(got[i].keep for i in range(300, 305))
    assert statistics.mean(got[i].keep for i in range(150)) > 0.97
    assert {r.doc_id: r for r in Q.decide(Q.measure(docs), min_group=20, send=0).drop("text_hash").collect()} == got  # the shuffled way to the fences
    assert {r.doc_id for r in Q.accepted(docs, min_group=20).collect()} == {i for i, r in got.items() if r.keep}


def test_rare_languages_are_not_judged_by_others(spark):
    rng = random.Random(6)
    english = "the house of people and water in time with other work they made new from many good days".split()
    greek = "το σπίτι των ανθρώπων και νερό στον χρόνο με άλλη δουλειά που έκαναν νέα από πολλές καλές ημέρες".split()
    text = lambda words, lo, hi: " ".join(rng.choice(words) for _ in range(rng.randrange(lo, hi)))
    rows = [(i, text(english, 60, 500), "en") for i in range(600)]
    rows += [(1000 + i, text(greek, 10, 120), "el") for i in range(60)] + [(1100 + i, text(greek, 10, 120), None) for i in range(40)]
    got = {r.doc_id: r for r in Q.quality_rules(make(spark, rows)).collect()}
    assert all(got[i].keep for i in got if i >= 1000)


def test_small_groups_pool_neighbouring_sizes_of_their_language(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(25, 120), 50), "xx") for i in range(180)] + [(200 + i, "same same same " * 50, "xx") for i in range(3)]
    docs = make(spark, rows)
    got = {r.doc_id: r for r in Q.quality_rules(docs, min_group=150).collect()}
    sizes = [r.size_class for r in got.values() if r.n_tokens >= 24]
    assert max(map(sizes.count, sizes)) < 150
    assert not any(got[i].keep for i in range(200, 203)) and statistics.mean(got[i].keep for i in range(180)) > 0.97


def test_odd_rows(spark, odd, empty):
    out = Q.accepted(odd)
    assert out.columns == odd.columns
    assert {1, 2, 3, 4, 7, 8, None} <= {r.doc_id for r in out.collect()}
    assert Q.accepted(empty).count() == 0 and Q.quality_rules(empty).count() == 0
    assert Q.quality_rules(odd.drop("lang")).count() == odd.count()
    assert Q.script_of_text("привет мир") == "Cyrillic" and Q.script_of_text("...") == "Other"
