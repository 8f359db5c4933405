"""Benchmark decontamination as a prefix-filtered set join.

Texts and benchmark items become sets of word shingles. The shingles of an item
are ordered by rarity, their document frequency in the corpus. For containment
of ``theta`` an item of m shingles needs o = ceil(theta m) of them, so a text
that has so many must have one of the m - o + 1 rarest, the prefix. Only prefix
shingles are joined with the texts; texts with one, of at least o shingles (the length
bound), are candidates of the item. A candidate looks at the text's hits within
a window's reach of its prefix hits; under o of them are of the item, it goes
(the positional bound). What is left is verified exactly: the largest number of
distinct item shingles in any window as long as the item.

Words are runs of letters, digits and non-ASCII characters of the lower-cased
text. The positions in a text of shingles that occur in the benchmark at all are
found in one pass; where the benchmark has more than ``broadcast_limit``
shingles, by a shuffled join instead of a lookup in each task. They serve for the
rarity and for the verification of candidates; the hits of a text without a
candidate meet no item.

Defined results: null, empty and wordless texts and items match nothing; texts
and items under ``n`` words have one shingle, of all their words; an item_id of
two texts is two items, each with a row of its own; rows that repeat a (doc_id,
text) count as one document; null ids are carried along; other columns are not
looked at. Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import WORDS, bounded, cut, i64, id64, rows_of, shingles, without, word_hashes, word_spans

HITS = "doc_id bigint, text_hash bigint, n_shingles bigint, pos bigint, h bigint"


def shingle_rows(docs: DataFrame, n: int, only: np.ndarray | None = None) -> DataFrame:
    """(doc_id, text_hash, n_shingles, pos, h) of all shingles, or of those whose hash is in the sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offs in rows_of(b):
                starts, ends, rows = word_spans(data, offs, WORDS)
                h, owner, _ = shingles(word_hashes(data, starts, ends), rows, n)
                if not len(h):
                    continue
                count = np.bincount(owner, minlength=len(offs) - 1)
                pos = np.arange(len(h)) - np.concatenate([[0], np.cumsum(count)])[owner]
                if only is not None:
                    at = np.searchsorted(only, h)
                    at[at == len(only)] = 0
                    hit = np.flatnonzero(only[at] == h) if len(only) else np.zeros(0, np.int64)
                    h, owner, pos = h[hit], owner[hit], pos[hit]
                if len(h):
                    take = pa.array(lo + owner)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), i64(count[owner].astype(np.int64)), i64(pos), i64(h)], names=["doc_id", "text_hash", "n_shingles", "pos", "h"])

    src = docs.where(F.col("text").isNotNull()).select(id64(docs), F.lower("text").alias("text"), F.xxhash64("text").alias("text_hash"))
    return src.mapInArrow(run, HITS)


def ranked(rows: DataFrame, hits: DataFrame, theta: float) -> DataFrame:
    """The shingles of each item with m, need and rank, the rarest in the corpus first."""
    rarity = hits.select("h", "doc_id", "text_hash").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    item = Window.partitionBy("item_id", "item_hash")
    out = rows.join(rarity, "h", "left").withColumn("m", F.count(F.lit(1)).over(item)).withColumn("need", F.ceil(F.col("m") * F.lit(theta) - 1e-9).cast("bigint"))
    return out.withColumn("rank", F.row_number().over(item.orderBy(F.coalesce("df", F.lit(0)), "h"))).drop("df")


def prefix(of: DataFrame) -> DataFrame:
    """The m - need + 1 rarest shingles of each item: a text with `need` of the item's shingles has one of them."""
    return of.where("rank <= m - need + 1").select("h", "item_id", "item_hash", "need")


def best_window(pos: np.ndarray, h: np.ndarray, span: int) -> tuple[int, int]:
    """The most distinct shingles in a window of span positions that begins at a hit, and the first such hit."""
    order = np.lexsort((pos, h))
    before = np.full(len(pos), -1 - span, np.int64)  # where the same shingle was last
    again = h[order][1:] == h[order][:-1]
    before[order[1:][again]] = pos[order[:-1][again]]
    # A hit counts for every window that holds it and no earlier hit of its shingle.
    first = np.searchsorted(pos, np.maximum(before, pos - span), side="right")
    change = np.bincount(first, minlength=len(pos) + 1) - np.bincount(np.arange(1, len(pos) + 1), minlength=len(pos) + 1)
    count = np.cumsum(change[:-1])
    at = int(np.argmax(count))
    return int(count[at]), int(pos[at])


def near_hits(pos: np.ndarray, marks: np.ndarray, span: int) -> np.ndarray:
    """Which sorted positions lie in a window of span with one of the sorted marks."""
    after = np.searchsorted(marks, pos)
    down = np.where(after > 0, pos - marks[np.maximum(after - 1, 0)], span)
    up = np.where(after < len(marks), marks[np.minimum(after, len(marks) - 1)] - pos, span)
    return np.minimum(down, up) < span


def verified(hits: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, m, pos) of candidate pairs that hold `need` shingles in one window.

    Hits and candidates of a text meet in one sorted partition; each pair looks at the hits near its prefix hits only.
    """
    a, b = found.alias("a"), items.alias("b")
    c = a.join(b, F.col("a.item_id").eqNullSafe(F.col("b.item_id")) & (F.col("a.item_hash") == F.col("b.item_hash"))).select("a.*", "span", "need", "s")
    none = lambda kind: F.lit(None).cast(kind)
    left = hits.select("doc_id", "text_hash", F.lit(0).alias("kind"), "pos", "h", none("bigint").alias("item_id"), none("bigint").alias("span"), none("bigint").alias("need"), none("array<bigint>").alias("marks"), none("array<bigint>").alias("s"))
    right = c.select("doc_id", "text_hash", F.lit(1).alias("kind"), none("bigint").alias("pos"), none("bigint").alias("h"), "item_id", "span", "need", "marks", "s")
    rows = left.unionByName(right).repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "kind", "pos", "item_id")

    def settle(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        col = {n: t.column(n).combine_chunks() for n in t.column_names}
        new = _new_text(col["doc_id"], col["text_hash"])
        first = np.flatnonzero(new)
        kind, pos, h = col["kind"].to_numpy(), col["pos"].fill_null(0).to_numpy(), col["h"].fill_null(0).to_numpy()
        out = []
        text = np.cumsum(new) - 1
        ends = np.append(first[1:], len(new))
        for i in np.flatnonzero(kind == 1).tolist():
            lo, hi = int(first[text[i]]), int(ends[text[i]])
            hi = lo + int(np.searchsorted(kind[lo:hi], 1))
            span, need, marks, s = (col[n][i] for n in ("span", "need", "marks", "s"))
            span, need, marks, s = span.as_py(), need.as_py(), np.sort(marks.values.to_numpy()), np.sort(s.values.to_numpy())
            p, x = pos[lo:hi], h[lo:hi]
            close = np.flatnonzero(near_hits(p, marks, span))
            at = np.minimum(np.searchsorted(s, x[close]), len(s) - 1)
            close = close[s[at] == x[close]]
            if len(close) < need:  # the positional bound
                continue
            best, where = best_window(p[close], x[close], span)
            if best >= need:
                out.append((i, best, len(s), where))
        take = pa.array([x[0] for x in out], pa.int64())
        return pa.RecordBatch.from_arrays([*(col[n].take(take) for n in ("doc_id", "text_hash", "item_id")), *(pa.array([x[j] for x in out], pa.int64()) for j in (1, 2, 3))], names=["doc_id", "text_hash", "item_id", "matched", "m", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 50_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_new_text(t.column("doc_id").combine_chunks(), t.column("text_hash").combine_chunks()))[-1])  # the last text may go on
            if last:
                yield settle(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, item_id bigint, matched bigint, m bigint, pos bigint")


def _new_text(doc: pa.Array, text: pa.Array) -> np.ndarray:
    new = np.ones(len(doc), bool)
    a, b, c = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(), text.to_numpy()
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    return new


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, theta: float = 0.7, broadcast_limit: int = 2_000_000) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, m, pos) of every document and item with containment of at least theta."""
    items = benchmark.select(id64(benchmark, "item_id").alias("doc_id"), "text")
    rows = cut(shingle_rows(items, n).select(F.col("doc_id").alias("item_id"), F.col("text_hash").alias("item_hash"), F.col("n_shingles").alias("span"), "h").distinct())
    known = bounded(rows.select("h").distinct(), broadcast_limit)
    if known is not None:
        hits = shingle_rows(docs, n, np.sort(known.column(0).to_numpy().view(np.uint64)))
    else:
        hits = shingle_rows(docs, n).join(rows.select("h").distinct(), "h", "left_semi")
    hits = cut(hits.distinct())
    order = cut(ranked(rows, hits, theta))
    # Only prefix shingles meet texts, and only texts that are long enough.
    found = hits.join(prefix(order), "h").where("n_shingles >= need").groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(F.collect_list("pos").alias("marks"))
    sets = order.groupBy("item_id", "item_hash").agg(F.first("span").alias("span"), F.first("need").alias("need"), F.collect_list("h").alias("s"))
    return verified(hits, found, sets)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The result as ids and measures: one row per document and item that it contains."""
    return contaminated(docs, benchmark, **how).select("doc_id", "item_id", "matched", (F.col("matched") / F.col("m")).alias("containment"), F.col("pos").alias("first_word"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that contain an item."""
    return without(docs, contaminated(docs, benchmark, **how).select("doc_id", "text_hash").distinct())


_SET = r"regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"
ORACLE = f"""
WITH d0 AS (SELECT doc_id, {_SET} AS w FROM documents WHERE text IS NOT NULL),
i0 AS (SELECT item_id, {_SET} AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, p - 1 AS pos, array_to_string(w[p:p+2], ' ') AS h FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS p FROM d0)),
i AS (SELECT DISTINCT item_id, greatest(len(w) - 2, 1) AS span, array_to_string(w[p:p+2], ' ') AS h FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS p FROM i0)),
s AS (SELECT item_id, count(*) AS m FROM i GROUP BY 1),
j AS (SELECT d.doc_id, i.item_id, d.pos, d.h, i.span FROM d JOIN i USING (h)),
k AS (SELECT a.doc_id, a.item_id, a.pos, count(DISTINCT b.h) AS c FROM j a JOIN j b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos >= a.pos AND b.pos < a.pos + a.span GROUP BY 1, 2, 3),
best AS (SELECT doc_id, item_id, max(c) AS c FROM k GROUP BY 1, 2)
SELECT best.doc_id, best.item_id, best.c AS matched, best.c / s.m AS containment, min(k.pos) AS first_word
FROM best JOIN s USING (item_id) JOIN k ON k.doc_id = best.doc_id AND k.item_id = best.item_id AND k.c = best.c
WHERE best.c >= ceil(s.m * 0.7 - 1e-9) GROUP BY 1, 2, 3, 4
"""
