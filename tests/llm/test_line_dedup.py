import random

import numpy as np
import pytest

from conftest_llm import make
from quillsift.llm import line_dedup as L


def brute(rows, least=24):
    seen: dict = {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate(t.split("\n")):
            if len(line.strip(" ")) >= least:
                seen.setdefault(line.strip(" "), (i, n))
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if len(x.strip(" ")) < least or seen[x.strip(" ")] == (i, n)) for i, t in rows if t is not None}


def corpus(seed, ids):
    rng = random.Random(seed)
    pool = [f"line number {k} that is long enough" for k in range(40)] + ["short", ""]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in ids]


def result(docs, drop):
    return {r.doc_id: r.text for r in L.rebuilt(docs, drop, "dropped").select("doc_id", "text").collect()}


def test_against_brute_force(spark):
    rows = corpus(1, range(60))
    for n in (1, 3):
        assert {r.doc_id: r.text for r in L.line_dedup(make(spark, rows), deliveries=n).collect()} == brute(rows)
    got = {r.doc_id: (r.text, r.removed) for r in L.line_dedup(make(spark, rows)).collect()}
    want = brute(rows)
    assert {k: v[0] for k, v in got.items()} == want
    assert all(got[i][1] == len(t.split("\n")) - (len(want[i].split("\n")) if want[i] or got[i][1] < len(t.split("\n")) else 0) for i, t in rows)


def snapshot(store):
    refs = {tuple(r) for r in store.refs.drop("delivery").collect()}
    sizes = {r.shard: len(L.CuckooFilter.of_bytes(bytes(r.filter))) for r in store.filters.collect()}
    return refs, sizes


def test_incremental_and_reversible(spark, tmp_path):
    a, b = corpus(1, range(30)), corpus(2, range(30, 60))
    da, db = make(spark, a), make(spark, b)
    store, _ = L.LineStore.empty(spark, 4).insert(da)
    store.save(f"{tmp_path}/one")
    store = L.LineStore.load(spark, f"{tmp_path}/one")
    both, drop = store.insert(db)
    assert result(db, drop) == {i: brute(a + b)[i] for i, _ in b}
    both.save(f"{tmp_path}/two")
    both = L.LineStore.load(spark, f"{tmp_path}/two")
    only_b, _ = L.LineStore.empty(spark, 4).insert(db)
    assert (store.shards, store.deliveries, both.deliveries) == (4, 1, 2)
    after, back = both.delete(da)
    left, want = snapshot(after), snapshot(only_b)
    assert left[0] == want[0] and {k: v for k, v in left[1].items() if v} == {k: v for k, v in want[1].items() if v}
    # The documents that get lines back are those whose texts change, and drops() has the lines of all.
    now = result(db, after.drops(db))
    assert now == brute(b)
    before = {i: brute(a + b)[i] for i, _ in b}
    assert {r.doc_id for r in back.collect()} == {i for i in now if now[i] != before[i]}
    again, drop = after.insert(da)
    assert snapshot(again)[0] == snapshot(both)[0]
    twice, drop = both.insert(da)  # what is there already stays as it is
    assert {tuple(r) for r in twice.refs.collect()} == {tuple(r) for r in both.refs.collect()}


def test_deletion_of_a_part_of_two_deliveries(spark):
    rows = [(i, t, ["de", "fr", "en", None][i % 4]) for i, t in corpus(5, range(80))]
    got = {r.doc_id: r.text for r in L.after_deletion(make(spark, rows), L.F.col("lang").isin("de", "fr"), L.F.col("lang") == "fr").collect()}
    order = [(i if x == "de" else i + 1000, t) for i, t, x in rows if x != "fr"]
    assert got == {i % 1000: t for i, t in brute(order).items()}


def test_reference_counts(spark):
    d = make(spark, [(1, "this line is long enough to count\nthis line is long enough to count"), (2, "this line is long enough to count")])
    store, _ = L.LineStore.empty(spark, 2).insert(d)
    assert [r.refs for r in store.references().collect()] == [3]
    assert [r.refs for r in store.delete(d.where("doc_id = 1"))[0].references().collect()] == [1]


@pytest.mark.parametrize("n", [10, 1000, 20_000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    h = rng.integers(-(1 << 62), 1 << 62, n)
    f = L.CuckooFilter.sized(n)
    assert f.insert(h) and len(f) == n and f.contains(h).all()
    other = rng.integers(-(1 << 62), 1 << 62, 20_000)
    assert f.contains(other).mean() < 0.001
    f = L.CuckooFilter.of_bytes(f.to_bytes())
    f.delete(h[: n // 2])
    twice = L.CuckooFilter.sized(8)
    assert twice.insert(np.array([5, 5, 5, 6]))
    twice.delete(np.array([5, 5]))
    assert len(twice) == 2 and twice.contains(np.array([5, 6])).all()
    assert f.contains(h[n // 2 :]).all() and f.contains(h[: n // 2]).mean() < 0.01 and len(f) == n - n // 2


def test_a_full_filter_is_built_again(spark):
    small, large = make(spark, corpus(1, range(2))), make(spark, [(i, f"a line that nobody else has, {i} times") for i in range(500)])
    store, _ = L.LineStore.empty(spark, 1).insert(small)
    store, _ = store.insert(large)
    assert len(L.CuckooFilter.of_bytes(bytes(store.filters.first().filter))) == store.references().count()


def test_odd_rows(spark, odd, empty):
    out = L.dedup(odd)
    assert out.columns == odd.columns and L.dedup(empty).count() == 0
    rows = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
    assert (9, "the same line of thirty letters") in rows and (2, None) in rows and (3, "") in rows and (None, None) in rows
    assert L.line_dedup(odd).count() == odd.count()
    clash = odd.drop("_qs_dropped", "_qs_hash").selectExpr("*", "1 AS _QS_Dropped", "2 AS _QS_HASH", "3 AS _qs_hash_")
    assert L.dedup(clash).columns == clash.columns and L.dedup(clash).count() == out.count()
    with pytest.raises(TypeError, match="doc_id must be an integer"):
        L.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_texts_of_many_lines(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join(f"some line of many, number {rng.randrange(900)}" for _ in range(1500))) for i in range(4)]
    assert {r.doc_id: r.text for r in L.line_dedup(make(spark, rows)).collect()} == brute(rows)
