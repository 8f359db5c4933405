import itertools
import random

import numpy as np

from conftest_llm import make
from quillsift.llm import packing as P
from quillsift.llm import pieces


def waste(lengths, ends):
    return sum(next(e for e in ends if e >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted(rng.choices(range(1, 40), k=rng.randrange(1, 30)))
        values, counts = np.unique(lengths, return_counts=True)
        for k in (1, 2, 3, 4):
            got = P.best_boundaries(values, counts, k)
            best = min(waste(lengths, [*c, values[-1]]) for r in range(k) for c in itertools.combinations(values[:-1], r))
            assert len(got) <= k and waste(lengths, got) == best


def plain_boundaries(longest, count, buckets):
    """The same programme without halving."""
    m = len(longest)
    total = np.concatenate([[0], np.cumsum(count)])
    best, back = [0] + [float("inf")] * m, []
    for _ in range(buckets):
        rows = [min((best[i] + (total[j] - total[i]) * longest[j - 1], i) for i in range(j)) for j in range(1, m + 1)]
        best = [0] + [c for c, _ in rows]
        back.append([0] + [i for _, i in rows])
    return best[m]


def test_long_lengths_are_optimal_too():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 150):
        for k in (1, 3, 12):
            values = np.unique(np.exp(rng.uniform(0, 12, n)).astype(np.int64))
            counts = rng.integers(1, 1000, len(values))
            ends = P.best_boundaries(values, counts, k)
            assert ends[-1] == values[-1] and len(ends) <= k
            padded = sum(int(c) * next(e for e in ends if e >= v) for v, c in zip(values.tolist(), counts))
            assert padded == plain_boundaries(values, counts, k)


def check(rows, budget):
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault((r.bucket_len, r.batch), []).append(r.slot)
    for (length, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        assert length * len(slots) <= budget or len(slots) == 1
    for length in {b for b, _ in batches}:
        full = [len(s) for (b, _), s in sorted(batches.items()) if b == length]
        assert all(x == max(1, budget // max(length, 1)) for x in full[:-1])
        assert len(full) == 1 + max(n for b, n in batches if b == length)


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i if i % 7 else None, rng.choice([0, 1, 3, 50, 70, 700, 3000])) for i in range(400)] + [(5, 3), (5, 3)]
    got = P.pack_counts(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), buckets=4, budget=500, block_rows=20).collect()
    assert len(got) == len(rows) and len({r.bucket_len for r in got}) <= 4
    check(got, 500)


def test_counts_are_those_of_the_tokeniser(spark):
    d = make(spark, [(1, "Hello wörld, again"), (2, None), (3, ""), (4, "日本語 " * 5), (5, "two\n\n  lines\nand  more \n"), (6, " \n\t ")])
    for path in (pieces.DEFAULT_MODEL, pieces.SECOND_MODEL):
        got = {r.doc_id: r.n_tokens for r in P.token_counts(d, path).collect()}
        assert got == {r.doc_id: pieces.word_table(path).vocabulary.whole(r.text) if r.text else 0 for r in d.collect()}


def test_odd_rows(spark, odd, empty):
    got = P.pack(odd, budget=100).collect()
    assert len(got) == odd.count() and P.pack(empty).count() == 0
    check(got, 100)
