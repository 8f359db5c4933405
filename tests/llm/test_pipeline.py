import random

import corpus_pipeline as P
from conftest_llm import ODD, make, prose

NAMES = ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "packing"]


def brute(rows, items):
    """The stages by their plain definitions, on texts that no quality rule rejects."""
    seen, kept = {}, []
    for i, t in rows:
        lines = []
        for n, line in enumerate(t.split("\n")):
            if len(line) < 24 or seen.setdefault(line, (i, n)) == (i, n):
                lines.append(line)
        if lines:
            kept.append((i, "\n".join(lines)))
    sh = {i: {tuple(t.lower().split()[j : j + 3]) for j in range(max(1, len(t.split()) - 2))} for i, t in kept}
    near = {i: i for i in sh}
    for a in sh:
        for b in sh:
            if a < b and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= 0.6:
                near[b] = min(near[b], near[a])
    kept = [(i, t) for i, t in kept if near[i] == i]
    return [(i, t) for i, t in kept if not any(x in t for x in items)]


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "\n".join(prose(rng, 25) for _ in range(4))) for i in range(60)]
    shared = prose(rng, 60)
    items = [(1, prose(rng, 30)), (2, prose(rng, 20))]
    for i in (5, 15, 25):
        rows[i] = (i, rows[i][1] + "\n" + shared)
    rows[30] = (30, rows[3][1])
    for i, j in ((31, 4), (32, 4)):  # near copies without a whole line in common
        w = rows[j][1].replace("\n", " ").split(" ")
        for _ in range(4):
            w[rng.randrange(len(w))] = "edit"
        rows[i] = (i, " ".join(w))
    rows[40] = (40, rows[40][1] + " " + items[0][1])
    rows[41] = (41, items[1][1] + " " + rows[41][1])
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in P.run(spark, str(tmp_path)).collect()}
    want = {i for i, _ in brute(rows, [t for _, t in items])}
    assert not {30, 31, 32, 40, 41} & want and got == want


def test_stages_are_those_and_keep_the_columns(spark, odd, tmp_path):
    assert [n for n, _ in P.STAGES] == NAMES
    spark.createDataFrame([(1, "a b c")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, make(spark, ODD), make(spark, [])):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert P.STAGES[-1][1](spark, odd, str(tmp_path)).count() == odd.count()
