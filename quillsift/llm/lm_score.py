"""Cross-entropy difference between a target and a background n-gram model.

Both models are bigram models over one vocabulary, the pieces of a public
tokeniser, with equal smoothing: interpolated absolute discounting over a
unigram with add-half counts. They are matched in all but their documents, which
are disjoint: the target model counts the documents of the target set, the
background model all others. Every document is scored as if it were not there:
its own counts are taken out of the model that has them first. So no model knows
a document from itself, and one that occurs twice is known from its other copy.
The score is the mean per-token loss under the background less that under the
target: the higher, the more a document is like the target set.

Counts go over all documents: each task combines its own, the rest is a
shuffled sum. The counts of distinct bigrams are one table. It is sent to every
task only up to ``broadcast_limit`` bigrams; beyond that documents are scored by a
shuffled join on the bigram. Counts of single pieces are at most the vocabulary.

Defined results: null, empty and blank texts have 0 tokens and null losses; a
null doc_id is scored but is never in the target set; a doc_id that the target
set repeats counts once; rows that repeat count each; a model without any
document is uniform; other columns are not looked at. doc_id is read as a 64-bit
integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import pieces
from quillsift.llm.common import bounded, cut, i64, id64, rows_of

START = 1  # every document begins after the start piece
DISCOUNT = 0.75
ROWS = 500


def encoded(docs: DataFrame, target: DataFrame, model: str, target_limit: int = 2_000_000) -> DataFrame:
    """(doc_id, in_target, ids): the piece ids of every whole text as 16-bit values.

    Up to target_limit ids of the target set go to every task, so that encoded texts stay where
    they are; a larger set is joined by a shuffle.
    """
    t = target.select(F.col("doc_id").cast("bigint").alias("_t")).where("_t IS NOT NULL").distinct()
    few = bounded(t, target_limit)
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(few.column(0).to_numpy())) if few is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in rows_of(b):
                ids, offs, _, _ = pieces.encode_docs(data, at, model)
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((offs * 2).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                own = b.column(0).slice(lo, hi - lo)
                inside = np.zeros(hi - lo, bool)
                if sent is not None and len(sent.value):
                    known = np.minimum(np.searchsorted(sent.value, own.fill_null(0).to_numpy()), len(sent.value) - 1)
                    inside = (sent.value[known] == own.fill_null(0).to_numpy()) & own.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([own, pa.array(inside), raw], names=["doc_id", "in_target", "ids"])

    src = docs.select(id64(docs), "text").mapInArrow(run, "doc_id bigint, in_target boolean, ids binary")
    if few is not None:
        return src
    return src.join(t, src["doc_id"] == t["_t"], "left").select("doc_id", F.col("_t").isNotNull().alias("in_target"), "ids")


def bigrams(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """previous << 16 | piece for each token of each row, and the row."""
    col = b.column(at)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    ids = raw.view(np.uint16).astype(np.int64)
    n = np.diff(offs) // 2
    rows = np.repeat(np.arange(len(n)), n)
    prev = np.empty_like(ids)
    prev[1:] = ids[:-1]
    starts = ((offs[:-1] - offs[0]) // 2)[n > 0]
    prev[starts] = START
    return prev << 16 | ids, rows


def bigram_counts(docs: DataFrame) -> DataFrame:
    """(g, nb, nt): how often each bigram is in the background and in the target documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged() -> tuple:
            g, nb, nt = (np.concatenate(x) for x in zip(*held))
            u, inv = np.unique(g, return_inverse=True)
            return u, np.bincount(inv, nb, len(u)), np.bincount(inv, nt, len(u))

        def out() -> pa.RecordBatch:
            u, nb, nt = merged()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(nb.astype(np.int64)), pa.array(nt.astype(np.int64))], names=["g", "nb", "nt"])

        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                g, rows = bigrams(part, 1)
                if not len(g):
                    continue
                inside = part.column(0).to_numpy(zero_copy_only=False).astype(bool)[rows]
                u, inv = np.unique(g, return_inverse=True)
                held.append((u, np.bincount(inv, ~inside, len(u)), np.bincount(inv, inside, len(u))))
                size += len(u)
                if size > 1_500_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:  # beyond a task's memory: the shuffle sums the rest
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return docs.select("in_target", "ids").mapInArrow(run, "g bigint, nb bigint, nt bigint").groupBy("g").agg(F.sum("nb").alias("nb"), F.sum("nt").alias("nt"))


class Singles:
    """Counts of single pieces under both models: as a word (u), as a head (h), kinds of successors (k), in all (z)."""

    def __init__(self, counts: DataFrame, vocabulary: int) -> None:
        both = ("nb", "nt")
        kinds = [F.count_if(F.col(n) > 0).alias("k" + n) for n in both]
        c = counts.select(F.shiftright("g", 16).alias("h"), F.col("g").bitwiseAND(0xFFFF).alias("w"), *both)
        words = c.groupBy(F.col("w").alias("i")).agg(*[F.sum(n).alias("u" + n) for n in both]).toArrow()
        heads = c.groupBy(F.col("h").alias("i")).agg(*[F.sum(n).alias("h" + n) for n in both], *kinds).toArrow()
        self.vocabulary = vocabulary
        for table, names in ((words, "u"), (heads, "hk")):
            for name in names:
                x = np.zeros((2, 1 << 16))
                for i, n in enumerate(both):
                    x[i, table.column("i").to_numpy()] = table.column(name + n).to_numpy()
                setattr(self, name, x)
        self.z = self.u.sum(1)


def losses(row: np.ndarray, g: np.ndarray, c: np.ndarray, counts: tuple[np.ndarray, np.ndarray], inside: np.ndarray, s: Singles) -> np.ndarray:
    """Log likelihood of each row under both models, from its distinct bigrams g that it has c times.

    Entries are sorted by (row, g). counts: of each entry under both models; inside: the model of each row.
    """
    n = len(inside)
    head, word = g >> 16, g & 0xFFFF
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (head[1:] != head[:-1])
    group = np.cumsum(new) - 1
    own_head = np.bincount(group, c)[group] if len(g) else c
    _, place = np.unique(row << 16 | word, return_inverse=True)
    own_word = np.bincount(place, c)[place] if len(g) else c
    own_all = np.bincount(row, c, n)[row]
    out = []
    for i, nb in enumerate(counts):
        mine = inside[row] == bool(i)
        alone = mine & (nb == c)  # the row is the only one with this bigram
        kinds = s.k[i, head] - (np.bincount(group, alone)[group] if len(g) else 0)
        less = lambda whole, own: whole - np.where(mine, own, 0)  # noqa: B023, E731
        h = less(s.h[i, head], own_head)
        uni = (less(s.u[i, word], own_word) + 0.5) / (less(s.z[i], own_all) + 0.5 * s.vocabulary)
        safe = np.maximum(h, 1)
        p = np.where(h > 0, np.maximum(less(nb, c) - DISCOUNT, 0) / safe + DISCOUNT * kinds / safe * uni, uni)
        out.append(np.bincount(row, c * np.log(p), n))
    return np.stack(out)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, model: str = pieces.DEFAULT_MODEL, broadcast_limit: int = 4_000_000) -> DataFrame:
    """(doc_id, n_tokens, loss_background, loss_target, score) of every document; losses in nats a token."""
    have = cut(encoded(docs, target, model))
    table = cut(bigram_counts(have))
    singles = docs.sparkSession.sparkContext.broadcast(Singles(table, pieces.word_table(model).vocabulary.size))
    out = _by_lookup(have, table, singles) if table.count() <= broadcast_limit else _by_join(have, table, singles)
    per = lambda x: F.when(F.col("n") > 0, -F.col(x) / F.col("n"))
    return out.select("doc_id", F.col("n").alias("n_tokens"), per("b").alias("loss_background"), per("t").alias("loss_target"), (per("b") - per("t")).alias("score"))


def own_counts(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bigram and how often, sorted by both; of fewer than 2^31 rows."""
    g, rows = bigrams(part, at)
    order = np.lexsort((g, rows))
    g, rows = g[order], rows[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return rows[first], g[first], np.diff(np.append(first, len(g)))


def _by_lookup(docs: DataFrame, table: DataFrame, singles) -> DataFrame:
    got = table.toArrow()
    g = got.column("g").to_numpy()
    order = np.argsort(g)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(x[order] for x in (g, got.column("nb").to_numpy(), got.column("nt").to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nb, nt = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                row, x, c = own_counts(part, 2)
                at = np.searchsorted(keys, x)
                inside = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                found = losses(row, x, c, (nb[at], nt[at]) if len(x) else (c, c), inside, singles.value)
                yield pa.RecordBatch.from_arrays([part.column(0), i64(np.bincount(row, c, len(inside)).astype(np.int64)), pa.array(found[0]), pa.array(found[1])], names=["doc_id", "n", "b", "t"])

    return docs.select("doc_id", "in_target", "ids").mapInArrow(run, "doc_id bigint, n bigint, b double, t double")


def _by_join(docs: DataFrame, table: DataFrame, singles) -> DataFrame:
    """The way for tables of any size: one row per document and distinct bigram meets the table."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                row, g, c = own_counts(part, 2)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), i64(g), i64(c.astype(np.int64))], names=["row", "in_target", "g", "c"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            row, inside, g, c, nb, nt = cols
            first = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
            at = np.cumsum(np.diff(row, prepend=row[0]) != 0)
            found = losses(at, g, c, (nb, nt), inside[first], singles.value)
            return pa.RecordBatch.from_arrays([i64(row[first]), i64(np.bincount(at, c).astype(np.int64)), pa.array(found[0]), pa.array(found[1])], names=["row", "n", "b", "t"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last document may go on in the next batch
            if last or (held and held[-1][0][0] != cols[0][0]):
                whole = [*held, [x[:last] for x in cols]]
                yield out([np.concatenate(x) for x in zip(*whole)])
                held = []
            held.append([x[last:] for x in cols])
        if held:
            yield out([np.concatenate(x) for x in zip(*held)])

    d = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "in_target", "ids"))
    long = d.select("row", "in_target", "ids").mapInArrow(split, "row bigint, in_target boolean, g bigint, c bigint").join(table, "g")
    sums = long.select("row", "in_target", "g", "c", "nb", "nt").repartition("row").sortWithinPartitions("row", "g").mapInArrow(judge, "row bigint, n bigint, b double, t double")
    j = d.select("row", "doc_id").join(sums, "row", "left")
    return j.select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "b", "t")
