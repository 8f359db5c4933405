import random
import re

import numpy as np

from conftest_llm import make, prose
from quillsift.llm import decontaminate as D

ITEMS = "item_id bigint, text string"


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def shingles(w, n=3):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])


def brute(rows, items, theta=0.7):
    """Containment by trying every window."""
    out = {}
    for i, t in items:
        s = shingles(words(t))
        for d, text, *_ in rows:
            have = shingles(words(text))
            best = max((len(set(have[p : p + len(s)]) & set(s)) for p in range(len(have))), default=0)
            if s and best >= theta * len(set(s)) - 1e-9:
                out[d, i] = best
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([2, 12, 30, 50]), 300)) for i in range(12)] + [(90, None), (91, ""), (92, "..."), (93, "same words here again"), (94, "Same words, here AGAIN!")]
    rows = []
    for d in range(60):
        w = prose(rng, rng.randrange(0, 120), 300).split()
        if d % 3:
            part = (rng.choice(items[:12])[1]).split()
            for _ in range(int(len(part) * rng.choice([0, 0.05, 0.1, 0.3]))):
                part[rng.randrange(len(part))] = "zz"
            at = rng.randrange(len(w) + 1)
            w[at:at] = part[:: rng.choice([1, 1, 1, 2])]
        rows.append((d, " ".join(w)))
    rows += [(100, "same words here again. " * 3), (101, "same  words—here again")]
    want = brute(rows, items)
    docs, bench = make(spark, rows), spark.createDataFrame(items, ITEMS)
    assert len(want) > 10
    for limit in (10**6, 3):  # a lookup in each task, and the shuffled join
        got = {(r.doc_id, r.item_id): r.matched for r in D.decontaminate(docs, bench, broadcast_limit=limit).collect()}
        assert got == want
    kept = {r.doc_id for r in D.clean(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}


def test_only_prefix_shingles_meet_texts(spark):
    rng = random.Random(4)
    items = spark.createDataFrame([(i, prose(rng, 40, 200)) for i in range(10)], "doc_id bigint, text string")
    rows = D.shingle_rows(items, 3).selectExpr("doc_id AS item_id", "text_hash AS item_hash", "n_shingles AS span", "h").distinct()
    hits = D.shingle_rows(make(spark, [(i, prose(rng, 500, 200)) for i in range(40)]), 3)
    order = D.ranked(rows, hits, 0.7)
    for r in order.groupBy("item_id").agg({"m": "max", "need": "max"}).collect():
        assert D.prefix(order).where(f"item_id = {r.item_id}").count() == r["max(m)"] - r["max(need)"] + 1
    df = {r.h: r["count"] for r in hits.select("h", "doc_id").distinct().groupBy("h").count().collect()}
    by = {}
    for r in order.orderBy("item_id", "rank").collect():
        by.setdefault(r.item_id, []).append(df.get(r.h, 0))
    assert all(x == sorted(x) for x in by.values())


def test_best_window_and_reach():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pos = np.sort(rng.permutation(60)[: rng.integers(1, 30)])
        h, span = rng.integers(0, 6, len(pos)), int(rng.integers(1, 20))
        counts = [len({x for q, x in zip(pos, h) if p <= q < p + span}) for p in pos]
        assert D.best_window(pos, h, span) == (max(counts), pos[counts.index(max(counts))])
        marks = np.sort(rng.permutation(60)[:3])
        assert D.near_hits(pos, marks, span).tolist() == [min(abs(p - m) for m in marks) < span for p in pos]


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "long long long long"), (2, None)], ITEMS)
    got = {(r.doc_id, r.item_id) for r in D.decontaminate(odd, bench).collect()}
    assert {(1, 1), (None, 1), (7, 1), (6, None)} <= got
    out = D.clean(odd, bench)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 8, 9, None}
    assert D.clean(empty, bench).count() == 0 and D.clean(odd, bench.limit(0)).count() == odd.count()
