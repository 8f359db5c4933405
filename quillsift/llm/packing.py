"""Packing by optimal length buckets.

The global histogram of token counts goes to the driver, one row for each
distinct length: lengths that differ sum to at most all tokens, so T tokens have
at most sqrt(2 T) of them, 4.5 million for 10^13 tokens. Dynamic programming
over the histogram chooses the ``buckets`` boundaries that minimise total
padding, each bucket padding to its longest document. The best last boundary
never moves down as lengths grow, so a layer costs m log m steps. Inside a bucket
documents fill batches of at most ``budget`` padded tokens, in the order of
(block, doc_id), where blocks of about ``block_rows`` rows by hash spread a
bucket over many tasks: the place of a document is its rank in its block plus the
size of the blocks before.

Defined results: null and empty texts have 0 tokens and share the first bucket
with the shortest texts; blank texts have the tokens of their white space; a text longer than the budget is a batch of its own; rows that repeat a
doc_id are packed one by one; null doc_ids sort first in their blocks; an empty
table gives an empty result; other columns are not looked at. doc_id is read as
a 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm import pieces
from quillsift.llm.common import cut, i64, id64, rows_of


def token_counts(docs: DataFrame, model: str = pieces.SECOND_MODEL) -> DataFrame:
    """(doc_id, n_tokens, text_hash): the length of the whole text, white space included, under a public vocabulary; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in rows_of(b):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), i64(pieces.count_docs(data, offs, model)), part.column(2)], names=["doc_id", "n_tokens", "text_hash"])

    return docs.select(id64(docs), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id bigint, n_tokens bigint, text_hash bigint")


def _layer(best: np.ndarray, total: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least best[i] + cost of a bucket of lengths i..j-1, and its i, by halving all ranges of j at once."""
    m = len(longest)
    new, arg = np.zeros(m + 1), np.zeros(m + 1, np.int64)
    a, b, lo, hi = (np.array([x]) for x in (1, m, 0, m - 1))  # j in a..b has its i in lo..hi
    while len(a):
        j = (a + b) // 2
        n = np.minimum(hi, j - 1) - lo + 1
        first = np.cumsum(n) - n
        i = np.arange(int(n.sum())) + np.repeat(lo - first, n)
        to = np.repeat(j, n)
        cost = best[i] + (total[to] - total[i]) * longest[to - 1]
        least = np.minimum.reduceat(cost, first)
        hit = np.flatnonzero(cost == np.repeat(least, n))
        at = i[hit[np.searchsorted(hit, first)]]
        new[j], arg[j] = least, at
        left, right = a < j, j < b
        a, b, lo, hi = (np.concatenate(x) for x in ((a[left], j[right] + 1), (j[left] - 1, b[right]), (lo[left], at[right]), (at[left], hi[right])))
    return new, arg


def best_boundaries(longest: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Of distinct lengths in order, the padded lengths of at most `buckets` buckets with least total padding."""
    m = len(longest)
    if not m:
        return []
    # The tokens themselves are the same for any choice, so padded tokens are minimised.
    total = np.concatenate([[0], np.cumsum(count)]).astype(np.float64)
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    back = []
    for _ in range(min(buckets, m)):
        best, arg = _layer(best, total, longest.astype(np.float64))
        back.append(arg)
    ends, j = [], m
    for arg in reversed(back):
        ends.append(int(longest[j - 1]))
        j = int(arg[j])
        if j == 0:
            break
    return sorted(ends)


def boundaries(counts: DataFrame, buckets: int) -> list[int]:
    got = counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    length, n = (got.column(c).to_numpy() for c in ("n_tokens", "n"))
    order = np.argsort(length)
    return best_boundaries(length[order], n[order], buckets)


def pack_counts(counts: DataFrame, buckets: int = 12, budget: int = 65_536, block_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, n_tokens, bucket_len, batch, slot): batch numbers count from 0 within each bucket."""
    counts = cut(counts)
    ends = boundaries(counts, buckets)
    if not ends:
        return counts.select("doc_id", "n_tokens", F.lit(0).cast("bigint").alias("bucket_len"), F.lit(0).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("slot"))
    bucket = F.lit(ends[-1])
    for e in reversed(ends[:-1]):
        bucket = F.when(F.col("n_tokens") <= e, F.lit(e)).otherwise(bucket)
    blocks = max(16, -(-counts.count() // block_rows))
    # The text is hashed too, as many rows may share a null id.
    block = F.pmod(F.xxhash64("doc_id", "n_tokens", *[c for c in counts.columns if c == "text_hash"]), F.lit(blocks)).cast("int")
    c = counts.withColumn("bucket_len", bucket.cast("bigint")).withColumn("block", block)
    per = c.groupBy("bucket_len", "block").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("bucket_len").orderBy("block")) - F.col("n")).select("bucket_len", "block", "before")
    rank = F.row_number().over(Window.partitionBy("bucket_len", "block").orderBy("doc_id", "n_tokens")) - 1
    # At most buckets x blocks rows: one for some 170,000 rows of the table.
    at = c.withColumn("rank", rank).join(F.broadcast(before), ["bucket_len", "block"]).withColumn("at", F.col("rank") + F.col("before"))
    room = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1))
    return at.select("doc_id", "n_tokens", "bucket_len", F.floor(F.col("at") / room).cast("bigint").alias("batch"), (F.col("at") % room).cast("bigint").alias("slot"))


def pack(docs: DataFrame, model: str = pieces.SECOND_MODEL, **how) -> DataFrame:
    return pack_counts(token_counts(docs, model), **how)
