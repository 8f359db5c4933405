"""Shared helpers: checkpoints, row keys and vectorised word hashing over Arrow text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session gets a folder of its own where it is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillsift-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, readable after any executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rows_of(batch: pa.RecordBatch, name: str = "text", max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): runs of rows of about max_bytes, one row at least. Nulls are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if n == 0:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + max_bytes, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end, data[offs[start] : offs[end]], offs[start : end + 1] - offs[start]
        start = end


def byte_class(pattern: bytes) -> np.ndarray:
    """A 256-entry table, true where the single byte matches the pattern."""
    rx = re.compile(pattern, re.S)
    return np.array([rx.fullmatch(bytes([b])) is not None for b in range(256)])


SPACE_SPLIT = ~byte_class(rb"[\t\n\x0b\x0c\r ]")
WORDS = byte_class(rb"[0-9a-zA-Z\x80-\xff]")

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
_P = U64(0xD6E8FEB86659FD93)
_PI = U64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, CHUNK_BYTES + 1024)
        if size > 1 << 23:  # a very long text: not kept
            return _powers(_P, n), _powers(_PI, n)
        _POW, _INV = _powers(_P, size), _powers(_PI, size)
    return _POW, _INV


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes in the class; runs never cross rows."""
    inside = table[data]
    n = len(data)
    edges = offs[(offs > 0) & (offs < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial over random byte values, finalised."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(data) + 1)
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=acc[1:])
    return mix64((acc[ends] - acc[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in a row, their rows, and the index of their first word.

    A row of fewer than k words has one shingle, of all its words.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = rows[1:] != rows[:-1]
    h = np.zeros(n, np.uint64)
    full = np.zeros(n, bool)
    for j in range(k):
        c = U64((int(_ODD) * (2 * j + 3) + 0x1234567) & ((1 << 64) - 1) | 1)
        if j == 0:
            h += words * c
            full[:] = True
            continue
        same = np.zeros(n, bool)
        same[: n - j] = rows[j:] == rows[: n - j]
        part = np.zeros(n, np.uint64)
        part[: n - j] = words[j:] * c
        h += np.where(same, part, U64(0))
        full = same
    firsts = np.flatnonzero(new)
    short = np.zeros(n, bool)
    sizes = np.diff(np.append(firsts, n))
    short[firsts[sizes < k]] = True
    at = np.flatnonzero(full | short)
    return mix64(h[at]), rows[at], at


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a 2-D array as one binary value."""
    m = np.ascontiguousarray(matrix)
    n, width = m.shape[0], m.shape[1] * m.itemsize if m.ndim == 2 else 0
    offs = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(m.tobytes())])


def matrix_of(col: pa.Array, kind: type) -> np.ndarray:
    """The inverse of binary_rows for values of one width."""
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].reshape(len(col), -1).view(kind)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_qs_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id64(df: DataFrame, name: str = "doc_id") -> F.Column:
    """The id column as a 64-bit integer; other than integers are refused by name instead of failing in a task."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{name} must be an integer column, not {kind.simpleString()}")
    return F.col(name).cast("bigint").alias(name)


def columns_of(df: DataFrame) -> list[F.Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs less the (doc_id, text_hash) of bad; null ids compare as equal."""
    own, other, its = fresh(docs, "hash", "id", "bad")
    d = docs.withColumn(own, F.xxhash64("text"))
    b = bad.select(F.col("doc_id").alias(other), F.col("text_hash").alias(its))
    return d.join(b, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(own) == F.col(its)), "left_anti").select(*columns_of(docs))


def bounded(df: DataFrame, limit: int) -> pa.Table | None:
    """The rows where there are at most limit of them, else None: the check before anything is sent to every executor."""
    got = df.limit(limit + 1).toArrow()
    return None if got.num_rows > limit else got
