import math
import random
import re
from collections import Counter

import numpy as np

from conftest_llm import make, prose
from quillsift.llm import lm_score as L
from quillsift.llm import pieces
from quillsift.llm import quality_model as Q
from quillsift.llm.common import mix64, word_hashes


def brute_lm(rows, target):
    """Each document under models that count all other documents of their side."""
    v = pieces.word_table(pieces.DEFAULT_MODEL).vocabulary
    ids = [[x for w in (t or "").split() for x in v.each([w])[0]] for _, t in rows]
    inside = [i in target for i, _ in rows]
    out = []
    for me, x in enumerate(ids):
        both = []
        for side in (False, True):
            others = [y for k, y in enumerate(ids) if inside[k] == side and k != me]
            bi = Counter(p for y in others for p in zip([L.START] + y, y))
            uni, head, kinds = Counter(), Counter(), Counter()
            for (h, w), n in bi.items():
                uni[w] += n
                head[h] += n
                kinds[h] += 1
            total, loss = sum(uni.values()), 0.0
            for h, w in zip([L.START] + x, x):
                u = (uni[w] + 0.5) / (total + 0.5 * v.size)
                loss -= math.log(max(bi[h, w] - L.DISCOUNT, 0) / head[h] + L.DISCOUNT * kinds[h] / head[h] * u if head[h] else u)
            both.append(loss / len(x) if x else None)
        out.append(both)
    return out


def test_losses_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(0, 30), 30 if i % 2 else 300)) for i in range(30)] + [(50, None), (51, ""), (52, " ")]
    target = spark.createDataFrame([(i,) for i in range(1, 30, 2)] + [(1,), (None,), (999,)], "doc_id bigint")
    rows += [(3, rows[3][1]), (4, rows[4][1]), (60, rows[5][1]), (61, rows[6][1])]  # repeated rows, and copies on the other side
    want = brute_lm(rows, set(range(1, 30, 2)))
    key = lambda x: (x[0], x[1] or 0)
    for limit in (10**6, 1):  # a lookup in each task, and the shuffled join
        got = L.cross_entropy_difference(make(spark, rows), target, broadcast_limit=limit).collect()
        got = sorted(((r.doc_id, r.loss_background, r.loss_target, r.score) for r in got), key=key)
        for r, (i, b, t) in zip(got, sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key), strict=True):
            assert r[0] == i
            if b is None:
                assert r[1:] == (None, None, None)
            else:
                assert math.isclose(r[1], b, rel_tol=1e-9) and math.isclose(r[2], t, rel_tol=1e-9) and math.isclose(r[3], b - t, abs_tol=1e-9)
    joined = L.encoded(make(spark, rows), target, pieces.DEFAULT_MODEL, target_limit=1)
    sent = L.encoded(make(spark, rows), target, pieces.DEFAULT_MODEL)
    key = lambda r: (r.doc_id, r.in_target, bytes(r.ids))
    assert sorted(map(key, joined.collect())) == sorted(map(key, sent.collect()))


def test_lm_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([(1,)], "doc_id bigint")
    assert L.cross_entropy_difference(odd, target).count() == odd.count()
    assert L.cross_entropy_difference(odd, target.limit(0)).where("score IS NOT NULL").count() > 0
    assert L.cross_entropy_difference(empty, target).count() == 0


LABELS = "doc_id bigint, quality int, toxic int"


def labelled_corpus(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        t = prose(rng, rng.randrange(30, 90), 800).split()
        if not good:
            t = [w.upper() + "!!" for w in t]
        if toxic:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["vileword", "uglyword"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled_corpus(1, 1200)
    known = spark.createDataFrame(labels[:800], LABELS)
    got = {r.doc_id: r for r in Q.quality_scores(make(spark, rows), known).collect()}
    held = labels[800:]
    assert np.mean([(got[i].quality >= 0.5) == q for i, q, _ in held]) > 0.95
    assert np.mean([(got[i].toxic >= 0.5) == t for i, _, t in held]) > 0.95
    assert np.mean([got[i].keep == (q and not t) for i, q, t in held]) > 0.92


def plain_hash(word):
    """The hash of one word, by the same function over a text of nothing else."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def brute_statistics(text, lexicon):
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    n = max(len(words), 1)
    out = [sum(Q._CLASS[b] == c for b in raw) / max(len(raw), 1) for c in range(Q.CLASSES)]
    out += [math.log1p(len(raw)), math.log1p(len(words)), min(len(raw) / max(len(re.findall(rb"[^\t\n\x0b\x0c\r ]+", raw)), 1), 50)]
    out += [len(set(words)) / n, max(Counter(words).values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n]
    terms = [plain_hash(w) for w in words] + [int(mix64(np.array([plain_hash(w[:6])], np.uint64))[0]) for w in words if len(w) > 6]
    q, t = ([lexicon.get(h, (0, 0))[i] for h in terms] for i in (0, 1))
    return out + [sum(q) / n, sum(min(x, 0) for x in q) / n, math.log1p(sum(max(x, 0) for x in t)), max([0, *t]), math.log1p(sum(x > 0 for x in t))]


def brute_isotonic(score, label, weight):
    """Least squares under monotonicity by the minimax formula, over sorted distinct scores."""
    cell = lambda a, b: sum(label[i] * weight[i] for i in range(a, b + 1)) / sum(weight[a : b + 1])
    m = len(score)
    return [max(min(cell(a, b) for b in range(i, m)) for a in range(i + 1)) for i in range(m)]


def test_isotonic_is_the_monotone_least_squares_fit():
    rng = np.random.default_rng(5)
    for _ in range(20):
        s = np.unique(rng.random(14))
        y, w = rng.random(len(s)), rng.integers(1, 5, len(s)).astype(float)
        x, fitted = Q.isotonic(s, y, w)
        want = brute_isotonic(s, y, w)
        base, pools = float((y * w).sum() / w.sum()), {}
        for v, k, u in zip(want, y, w):
            pools.setdefault(round(v, 9), []).append(u)
        shrunk = [(v * sum(pools[round(v, 9)]) + base) / (sum(pools[round(v, 9)]) + 1) for v in want]
        assert np.allclose(np.interp(s, x, fitted), np.maximum.accumulate(shrunk))


def test_scores_against_brute_force(spark):
    """The whole classifier in plain loops and dense algebra."""
    rows, labels = labelled_corpus(7, 900)
    labels += [(3, 0, 1), (9999, 1, 0), (None, 1, 1)]
    rows += [(5000, None), (5001, ""), (5002, "Grüße, Grüße! ABC 123\n")]
    docs, known = make(spark, rows), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in Q.quality_scores(docs, known).collect()}
    worst = {}
    for i, q, t in labels:
        if i is not None and i < 9999:
            a, b = worst.get(i, (1, 0))
            worst[i] = (min(a, q), max(b, t))
    order = {r.i: r.o for r in spark.createDataFrame([(i,) for i in worst], "i bigint").selectExpr("i", "xxhash64(i) AS o").collect()}
    part = {i: (order[i] >> 8) % 4 for i in worst}
    text = dict(rows)
    # the words
    seen, n, bad, toxic = {}, 0, 0, 0
    for i, (q, t) in worst.items():
        if part[i] < 2:
            n, bad, toxic = n + 1, bad + 1 - q, toxic + t
            low = re.findall(r"[0-9a-z]+", text[i].lower())
            for h in {plain_hash(w.encode()) for w in low} | {int(mix64(np.array([plain_hash(w[:6].encode())], np.uint64))[0]) for w in low if len(w) > 6}:
                a = seen.setdefault(h, [0, 0, 0])
                a[0], a[1], a[2] = a[0] + 1, a[1] + 1 - q, a[2] + t
    lexicon = {}
    for h, (c, b, t) in seen.items():
        if c >= 5:
            odds = lambda k, whole: math.log((k + 0.5) / (whole + 1) / ((c - k + 0.5) / (n - whole + 1)))  # noqa: B023, E731
            z = lambda k, whole: odds(k, whole) / math.sqrt(1 / (k + 0.5) + 1 / (c - k + 0.5))  # noqa: B023, E731
            w = (-odds(b, bad) if abs(z(b, bad)) > 4 else 0.0, odds(t, toxic) if z(t, toxic) > 4 else 0.0)
            if any(w):
                lexicon[h] = w
    assert lexicon
    x = {i: np.array(brute_statistics(t, lexicon)) for i, t in rows}
    train = [i for i in worst if part[i] == 2]
    mean = np.mean([x[i] for i in train], 0)
    scale = np.maximum(np.std([x[i] for i in train], 0), 1e-3)
    rng = np.random.default_rng(11)
    freq, phase = rng.normal(0, np.sqrt(1 / len(Q.NAMES)), (len(Q.NAMES), 256)), rng.uniform(0, 2 * np.pi, 256)
    z = {i: np.append(np.sqrt(2 / 256) * np.cos(np.clip((v - mean) / scale, -8, 8) @ freq + phase), 1) for i, v in x.items()}
    a, y = np.stack([z[i] for i in train]), np.array([worst[i] for i in train], float)
    weights = np.linalg.solve(a.T @ a + 1e-4 * len(train) * np.eye(257), a.T @ y)
    held = [i for i in worst if part[i] == 3]
    for head, name in enumerate(Q.HEADS):
        cells = {}
        for i in held:
            cells.setdefault(float(np.round(z[i] @ weights[:, head], 3)), []).append(worst[i][head])
        s = np.array(sorted(cells))
        curve = Q.isotonic(s, np.array([np.mean(cells[v]) for v in s]), np.array([len(cells[v]) for v in s], float))
        for i in text:
            assert abs(getattr(got[i], name) - np.interp(z[i] @ weights[:, head], *curve)) < 1e-4, (i, name)


def test_normal_equations_are_the_sum(spark):
    rng = np.random.default_rng(1)
    d = len(Q.NAMES)
    model = Q.Model(Q.Lexicon(), np.zeros(d), np.ones(d), rng.normal(size=(d, 8)), rng.uniform(0, 6, 8), np.zeros((9, 2)), [])
    x, y = rng.normal(size=(50, d)), rng.integers(0, 2, (50, 2))
    rows = spark.createDataFrame([(list(map(float, a)), int(q), int(t)) for a, (q, t) in zip(x, y)], "x array<double>, quality int, toxic int").repartition(3)
    a, b = Q.normal_equations(rows, model)
    z = model.features(x)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(2)
    d = len(Q.NAMES)
    model = Q.Model(Q.Lexicon(), np.zeros(d), np.ones(d), rng.normal(0, np.sqrt(1 / d), (d, 20_000)), rng.uniform(0, 2 * np.pi, 20_000), None, [])
    x = rng.normal(size=(6, d))
    z = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * d))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (6, 1, 0), (777, 0, 0), (9, 1, 1)], LABELS)
    got = Q.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.quality <= 1 for r in got)
    none = Q.quality_scores(odd, labels.limit(0)).collect()
    assert all(r.quality is None and r.keep for r in none) and Q.quality_scores(empty, labels).count() == 0
