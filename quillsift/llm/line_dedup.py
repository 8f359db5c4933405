"""Reversible line deduplication over sharded cuckoo filters.

A store holds, per shard of the line-hash space, a cuckoo filter, and beside
the filters an exact reference table: one row per line and document with the
number of times the document has the line and the delivery it came with. insert()
tests each distinct line of a delivery against its shard's filter: a miss proves the
line new; a hit is settled in the reference table. The first occurrence of a line,
by (delivery, doc_id, text_hash, line number), stays and later ones are removed
from their documents. delete() takes documents out of the reference table, and
lines that nobody holds any more out of the filters, so that deleting a delivery
gives the very store that would be there without it; it names the documents that
get lines back, and drops() tells the lines to remove from any documents as the
store stands.

``line_dedup`` takes the table in as ``deliveries`` by ranges of doc_id, so that all
after the first go through the filters; the result does not depend on their
number. An empty store has nothing to test against and needs no filter pass.

Only lines of ``min_chars`` characters after trimming take part; short lines
repeat in ordinary prose.

Defined results: a null text stays null; an empty text stays empty; a document
that loses all its lines is dropped by ``dedup`` with drop_empty and else has
an empty text; rows that repeat a (doc_id, text) are one document and get
equal results; a null doc_id sorts first; other columns pass unchanged. doc_id
must be an integer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import columns_of, cut, fresh, id64, mix64

SLOTS = 4
LINES_PER_SHARD = 250_000
REFS = "shard int, h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, n bigint, first_line int, delivery int"
FILTERS = "shard int, filter binary"


class CuckooFilter:
    """16-bit fingerprints in buckets of four, vectorised; deletions are exact for what was inserted."""

    def __init__(self, buckets: int) -> None:
        self.table = np.zeros((max(2, 1 << (int(buckets) - 1).bit_length()), SLOTS), np.uint16)

    @classmethod
    def sized(cls, lines: int) -> CuckooFilter:
        return cls(max(16, int(lines / SLOTS / 0.8) + 1))

    @classmethod
    def of_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls(2)
        out.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int((self.table != 0).sum())

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(np.asarray(hashes).astype(np.int64).view(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (mix64(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hashes)
        m = mark[:, None]
        return (self.table[one] == m).any(1) | (self.table[two] == m).any(1)

    def _settle(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts as many marks as fit into their buckets; gives which did."""
        done = np.zeros(len(mark), bool)
        for _ in range(SLOTS):
            left = np.flatnonzero(~done)
            if not len(left):
                break
            free = self.table[at[left]] == 0
            left = left[free.any(1)]
            if not len(left):
                break
            bucket, first = np.unique(at[left], return_index=True)
            who = left[first]
            self.table[bucket, (self.table[bucket] == 0).argmax(1)] = mark[who]
            done[who] = True
        return done

    def insert(self, hashes: np.ndarray, rounds: int = 200) -> bool:
        """False where the table is too full; the caller then rebuilds a larger one from the exact table."""
        mark, one, two = self._places(hashes)
        done = self._settle(mark, one)
        mark, at = mark[~done], two[~done]
        for turn in range(rounds):
            done = self._settle(mark, at)
            mark, at = mark[~done], at[~done]
            if not len(mark):
                return True
            bucket, first = np.unique(at, return_index=True)
            slot = turn % SLOTS
            out = self.table[bucket, slot].copy()
            self.table[bucket, slot] = mark[first]
            rest = np.ones(len(mark), bool)
            rest[first] = False
            mark, at = np.concatenate([mark[rest], out]), np.concatenate([self._other(at[rest], mark[rest]), self._other(bucket, out)])
        return False

    def delete(self, hashes: np.ndarray) -> None:
        mark, one, two = self._places(hashes)
        done = np.zeros(len(mark), bool)
        for at in (one, two):
            left = np.flatnonzero(~done)
            while len(left):
                same = self.table[at[left]] == mark[left][:, None]
                left, same = left[same.any(1)], same[same.any(1)]
                _, first = np.unique(at[left] * SLOTS + same.argmax(1), return_index=True)  # one for each slot at a time
                self.table[at[left[first]], same[first].argmax(1)] = 0
                done[left[first]] = True
                left = np.delete(left, first)


@dataclass
class LineStore:
    """refs: the exact reference table; filters: one cuckoo filter per shard; deliveries: how many were inserted."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 24
    deliveries: int = 0

    @classmethod
    def empty(cls, spark: SparkSession, shards: int, min_chars: int = 24) -> LineStore:
        return cls(spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS), shards, min_chars)

    def save(self, path: str) -> None:
        self.refs.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/refs")
        self.filters.write.mode("overwrite").parquet(f"{path}/filters")
        one = self.refs.sparkSession.createDataFrame([(self.shards, self.min_chars, self.deliveries)], "shards int, min_chars int, deliveries int")
        one.write.mode("overwrite").parquet(f"{path}/store")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineStore:
        refs = spark.read.schema(REFS).parquet(f"{path}/refs").select(*[x.split()[0] for x in REFS.split(", ")])
        return cls(refs, spark.read.schema(FILTERS).parquet(f"{path}/filters"), *spark.read.parquet(f"{path}/store").first())

    def settled(self) -> LineStore:
        """With both tables computed and checkpointed, for a store that goes on."""
        return LineStore(cut(self.refs), cut(self.filters), self.shards, self.min_chars, self.deliveries)

    def lines(self, docs: DataFrame) -> DataFrame:
        """One row per line that takes part: its hashes and where it is."""
        x = docs.select(id64(docs), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line", "s"))
        s = F.trim(F.col("s"))
        x = x.where(F.length(s) >= self.min_chars).select("doc_id", "text_hash", "line", F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"))
        return x.withColumn("shard", F.pmod("h1", F.lit(self.shards)).cast("int"))

    def insert(self, docs: DataFrame) -> tuple[LineStore, DataFrame]:
        """The new store, and (doc_id, text_hash, drop, dropped): a bitmap of the lines to remove and their number."""
        lines = self.lines(docs)
        # A row that repeats a (doc_id, text) is the same document: its lines are counted once.
        batch = lines.groupBy("shard", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first"))
        refs = lines.groupBy("shard", "h1", "h2", "doc_id", "text_hash").agg(F.size(F.collect_set("line")).cast("bigint").alias("n"), F.min("line").alias("first_line"), F.lit(self.deliveries).alias("delivery"))
        if not self.deliveries:
            owned = batch.where("n > 1").select("h1", "h2", F.col("first").alias("owner"))
            filters = batch.select("shard", "h1").groupBy("shard").applyInPandas(_build, FILTERS)
            return LineStore(refs, filters, self.shards, self.min_chars, 1), _bitmaps(lines, owned)
        batch = cut(batch)
        probed = cut(batch.select("shard", "h1").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_probe, "shard int, h1 bigint, seen boolean, filter binary"))
        maybe = probed.where("seen").select("shard", "h1")
        # Owners so far: only for lines that the filters can't rule out.
        held = self.refs.join(maybe.select("h1"), "h1", "left_semi")
        owned = batch.join(_owners(held), ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("owner").isNotNull())
        owned = owned.select("h1", "h2", F.coalesce("owner", "first").alias("owner"))
        ids = self.refs.select("doc_id", "text_hash").distinct()
        refs = refs.join(ids, refs["doc_id"].eqNullSafe(ids["doc_id"]) & (refs["text_hash"] == ids["text_hash"]), "left_anti")
        # Hits that the table proves new share a fingerprint with another line; they get one of their own.
        false_hits = maybe.join(held.select("h1").distinct(), "h1", "left_anti").select("shard", "h1")
        touched = probed.where(F.col("filter").isNotNull()).select("shard", "filter")
        filters = self.filters.join(touched, "shard", "left_anti").unionByName(touched)
        filters = filters.groupBy("shard").cogroup(false_hits.groupBy("shard")).applyInPandas(_add, FILTERS)
        return LineStore(self.refs.unionByName(refs), filters, self.shards, self.min_chars, self.deliveries + 1)._grown(), _bitmaps(lines, owned)

    def _grown(self) -> LineStore:
        """Filters that were too full come back empty; they are built again, larger, from the exact table."""
        full = self.filters.where(F.length("filter") == 0).select("shard")
        again = self.refs.join(full, "shard", "left_semi").select("shard", "h1").distinct().groupBy("shard").applyInPandas(_build, FILTERS)
        return LineStore(self.refs, self.filters.where(F.length("filter") > 0).unionByName(again), self.shards, self.min_chars, self.deliveries)

    def delete(self, docs: DataFrame) -> tuple[LineStore, DataFrame]:
        """Without these documents, and (doc_id, text_hash) of the documents that get lines back.

        A line that still has references keeps its fingerprint and gets the next owner.
        """
        gone = docs.select(id64(docs), F.xxhash64("text").alias("text_hash")).distinct()
        same = self.refs["doc_id"].eqNullSafe(gone["doc_id"]) & (self.refs["text_hash"] == gone["text_hash"])
        refs = cut(self.refs.join(gone, same, "left_anti"))
        out = cut(self.refs.join(gone, same, "left_semi"))
        lost = out.select("shard", "h1").distinct().join(refs.select("shard", "h1").distinct(), ["shard", "h1"], "left_anti")
        filters = self.filters.groupBy("shard").cogroup(lost.groupBy("shard")).applyInPandas(_remove, FILTERS)
        touched = out.select("h1", "h2").distinct()
        before = _owners(self.refs.join(touched, ["h1", "h2"], "left_semi")).withColumnRenamed("owner", "old")
        after = _owners(refs.join(touched, ["h1", "h2"], "left_semi"))
        back = after.join(before, ["h1", "h2"]).where(~F.col("owner").eqNullSafe(F.col("old"))).select("owner.doc_id", "owner.text_hash").distinct()
        return LineStore(refs, cut(filters), self.shards, self.min_chars, self.deliveries), back

    def drops(self, docs: DataFrame) -> DataFrame:
        """The bitmaps of insert() for documents of the store, as it stands now."""
        often = self.refs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), _first().alias("owner")).where("n > 1")
        return _bitmaps(self.lines(docs), often.select("h1", "h2", _place("owner").alias("owner")))

    def references(self) -> DataFrame:
        """Exact reference count of every line."""
        return self.refs.groupBy("shard", "h1", "h2").agg(F.sum("n").alias("refs"))


def _place(owner: str | None = None) -> F.Column:
    """Where a line is, of a row or of its owner."""
    at = f"{owner}." if owner else ""
    return F.struct(F.col(f"{at}doc_id").alias("doc_id"), F.col(f"{at}text_hash").alias("text_hash"), F.col(f"{at}line").alias("line"))


def _first() -> F.Column:
    """Of references, the one that came first."""
    return F.min(F.struct("delivery", "doc_id", "text_hash", F.col("first_line").alias("line")))


def _owners(refs: DataFrame) -> DataFrame:
    return refs.groupBy("h1", "h2").agg(_first().alias("owner")).select("h1", "h2", _place("owner").alias("owner"))


def _bitmaps(lines: DataFrame, owned: DataFrame) -> DataFrame:
    """Per document the lines that another place owns, as 64-bit words, so that a text of very many lines looks each up in few steps."""
    later = lines.join(owned, ["h1", "h2"]).where(~_place().eqNullSafe(F.col("owner")))
    words = later.groupBy("doc_id", "text_hash", F.shiftright("line", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, line % 64)")).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop"), F.sum(F.bit_count("bits")).alias("dropped"))


def _probe(key: tuple, batch: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    shard = int(key[0])
    h = np.unique(batch["h1"].to_numpy(np.int64)) if len(batch) else np.zeros(0, np.int64)
    have = CuckooFilter.of_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(2 * len(h))
    seen = have.contains(h) if len(h) else np.zeros(0, bool)
    ok = have.insert(h[~seen]) if (~seen).any() else True
    hits = h[seen]
    last = pd.DataFrame({"shard": [shard], "h1": [0], "seen": [False], "filter": [have.to_bytes() if ok else b""]})
    return pd.concat([pd.DataFrame({"shard": shard, "h1": hits, "seen": True, "filter": None}), last], ignore_index=True) if len(hits) else last


def _add(key: tuple, old: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
    raw = old["filter"].iloc[0] if len(old) else b""
    if raw and len(more):
        have = CuckooFilter.of_bytes(raw)
        raw = have.to_bytes() if have.insert(np.unique(more["h1"].to_numpy(np.int64))) else b""
    return pd.DataFrame({"shard": [int(key[0])], "filter": [raw]})


def _build(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
    h = np.unique(lines["h1"].to_numpy(np.int64))
    size = max(16, len(h))
    while True:
        made = CuckooFilter.sized(size)
        if made.insert(h):
            return pd.DataFrame({"shard": [int(key[0])], "filter": [made.to_bytes()]})
        size *= 2


def _remove(key: tuple, old: pd.DataFrame, lost: pd.DataFrame) -> pd.DataFrame:
    if not len(old):
        return pd.DataFrame({"shard": [], "filter": []}).astype({"shard": "int32", "filter": object})
    have = CuckooFilter.of_bytes(old["filter"].iloc[0])
    have.delete(np.unique(lost["h1"].to_numpy(np.int64)) if len(lost) else np.zeros(0, np.int64))
    return pd.DataFrame({"shard": [int(key[0])], "filter": [have.to_bytes()]})


def shard_count(docs: DataFrame) -> int:
    """A power of two that leaves about LINES_PER_SHARD lines to each shard."""
    n = docs.select(F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return 1 << max(3, int(np.ceil(np.log2(max(1, n / LINES_PER_SHARD)))))


def rebuilt(docs: DataFrame, drop: DataFrame, dropped: str) -> DataFrame:
    """docs with the given lines taken out of their texts, and a column `dropped` with their number."""
    own, other, bad, bits = fresh(docs, "hash", "id", "bad", "bits")
    b = drop.select(F.col("doc_id").alias(other), F.col("text_hash").alias(bad), F.col("drop").alias(bits), F.col("dropped").alias(dropped))
    j = docs.withColumn(own, F.xxhash64("text")).join(b, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(own) == F.col(bad)), "left")
    gone = lambda i: F.coalesce(F.getbit(F.try_element_at(bits, F.shiftright(i, 6)), i % 64), F.lit(0)) == 1
    text = F.when(F.col(bits).isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~gone(i)), "\n"))
    return j.withColumn("text", text).select(*columns_of(docs), F.coalesce(F.col(dropped), F.lit(0)).cast("bigint").alias(dropped))


def dedup(docs: DataFrame, min_chars: int = 24, store: LineStore | None = None, drop_empty: bool = True) -> DataFrame:
    """docs without repeated lines, with n_chars recounted where there is such a column."""
    store = store or LineStore.empty(docs.sparkSession, shard_count(docs), min_chars)
    _, drop = store.insert(docs)
    (n,) = fresh(docs, "dropped")
    out = rebuilt(docs, drop, n)
    if drop_empty:
        out = out.where((F.col(n) == 0) | (F.length(F.trim(F.col("text"))) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n) == 0, F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*columns_of(docs))


def line_dedup(docs: DataFrame, min_chars: int = 24, deliveries: int = 2) -> DataFrame:
    """doc_id, the text without repeated lines, and how many lines went, for every document."""
    docs = docs.select(id64(docs), "text")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    store, drop = LineStore.empty(docs.sparkSession, shard_count(docs), min_chars), None
    span = 1 if lo is None else (hi - lo) // deliveries + 1
    for i in range(deliveries):
        last = i == deliveries - 1
        part = docs.where(F.coalesce(F.floor((F.col("doc_id") - F.lit(lo or 0)) / span), F.lit(0)) == i)
        store, more = store.insert(part)
        drop = more if drop is None else drop.unionByName(more)
        store = store if last else store.settled()
    return rebuilt(docs, drop, "removed")


def after_deletion(docs: DataFrame, first: F.Column, gone: F.Column, min_chars: int = 24) -> DataFrame:
    """Two deliveries, `first` and the rest; then the documents of `gone` are deleted: the others with their lines as the store then stands."""
    store = LineStore.empty(docs.sparkSession, shard_count(docs), min_chars)
    first, gone = F.coalesce(first, F.lit(False)), F.coalesce(gone, F.lit(False))
    for part in (docs.where(first), docs.where(~first)):
        store = store.insert(part)[0].settled()
    store, _ = store.delete(docs.where(gone))
    left = docs.where(~gone).select(id64(docs), "text")
    return rebuilt(left, store.drops(left), "removed")


ORACLE = """
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS s FROM documents),
r AS (
  SELECT *, CASE WHEN length(trim(s)) >= 24 THEN row_number() OVER (PARTITION BY trim(s) ORDER BY doc_id, line) ELSE 1 END AS k FROM l)
SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (WHERE k = 1), '') AS text, count(*) FILTER (WHERE k > 1) AS removed
FROM r GROUP BY doc_id
"""

DELETION_ORACLE = ORACLE.replace("FROM documents)", "lang = 'de' AS early FROM documents WHERE lang IS DISTINCT FROM 'fr')").replace("AS s lang", "AS s, lang").replace("ORDER BY doc_id, line) ELSE", "ORDER BY coalesce(early, false) DESC, doc_id, line) ELSE")
