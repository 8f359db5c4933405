"""Secret scan by a battery of randomness tests.

Candidates are runs of key-like characters in whole texts: alphanumeric runs, runs
that may also hold the signs of base64 or of its URL form, and, where such a run
mixes the signs of both, its maximal parts of either alphabet. An alphanumeric part
of a longer run is a candidate of its own beside it, as a key may stand in a path, so
one key may be found twice, at two lengths. The alphabet of a
candidate tells its encoding (hexadecimal, base32, base36, base62, base64, or
letters of one case). Three tests ask whether its symbols are random over that
alphabet: chi-squared uniformity, a runs test about the alphabet's middle, and
lag-one serial correlation; Fisher's method combines them. How surprising the
combined value would be for ordinary text is read off strings of the same
length and encoding that a character model of the whole corpus generates; ordinary
text of more than GRID's last length is only less like a key, so its null is used there.
Within each stratum of encoding and length Benjamini-Hochberg bounds the share
of ordinary text among the findings; findings must also pass as random.

Only fingerprints leave the task that saw a candidate, never its characters.

Runs of digits alone are numbers and never candidates. Defined results: null,
empty and blank texts have no findings; a candidate that occurs twice is found
twice; a null doc_id is carried along; rows that repeat repeat their findings;
other columns are not looked at. doc_id must be an integer.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import byte_class, cut, id64, rows_of, word_spans

SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"
_CODE = np.full(256, len(SYMBOLS), np.int64)
for _i, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _i
ALPHABETS = {
    "hex": "0123456789abcdef", "hex_upper": "0123456789ABCDEF", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": SYMBOLS[:62], "base64": SYMBOLS[:62] + "+/", "base64_url": SYMBOLS[:62] + "-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
_ALNUM, _WIDE = byte_class(rb"[0-9A-Za-z]"), byte_class(rb"[0-9A-Za-z+/_-]")
_PARTS = (re.compile("[0-9A-Za-z+/]+"), re.compile("[0-9A-Za-z_-]+"))
_LUT = {k: np.array([v.find(chr(i)) for i in range(256)], np.int64) for k, v in ALPHABETS.items()}
GRID = np.array([16, 20, 24, 32, 40, 48, 64, 96, 128, 256, 512])
FOUND = "kind int, doc_id bigint, start bigint, length bigint, encoding string, fingerprint string, chi_z double, runs_z double, serial_z double, fisher double"


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that has all symbols; None for numbers and mixtures."""
    have = set(token)
    if have <= set("0123456789"):
        return None
    for name, alphabet in _SETS.items():
        if have <= alphabet:
            return name
    return None


def _tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def battery(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of symbol indexes below k: z of chi-squared, of runs, of serial correlation; Fisher's statistic."""
    rows, n = codes.shape
    counts = np.stack([np.bincount(r, minlength=k) for r in codes]).astype(np.float64)
    x2 = (counts**2).sum(1) * k / n - n
    df = k - 1
    chi = ((x2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = codes >= (k + 1) // 2
    a = high.sum(1).astype(np.float64)
    b = n - a
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    mean = 1 + 2 * a * b / n
    var = np.maximum((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9)
    runs_z = np.where((a == 0) | (b == 0), -math.sqrt(n), (runs - mean) / np.sqrt(var))
    c = codes - codes.mean(1, keepdims=True)
    power = (c**2).sum(1)
    serial = np.where(power > 0, (c[:, 1:] * c[:, :-1]).sum(1) / np.maximum(power, 1e-9) + 1 / n, 1.0) * math.sqrt(n)
    p = [_tail(chi), 2 * _tail(np.abs(runs_z)), 2 * _tail(np.abs(serial))]
    fisher = -2 * sum(np.log(np.maximum(x, 1e-300)) for x in p)
    return chi, runs_z, serial, fisher


def random_p(fisher: np.ndarray) -> np.ndarray:
    """Upper tail of chi-squared with 6 degrees of freedom."""
    h = fisher / 2
    return np.exp(-h) * (1 + h + h * h / 2)


def candidates(docs: DataFrame, least: int = 16) -> DataFrame:
    """One pass: kind 0 rows are tested candidates, kind 1 rows each task's counts (length) of symbol pairs (start)."""
    size = len(SYMBOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(size * size, np.int64)
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, _, data, offs in rows_of(b):
                code = _CODE[data]
                edge = np.zeros(len(data), bool)  # the first byte of a text makes no pair with the one before
                edge[offs[:-1][offs[:-1] < len(data)]] = True
                both = (code[:-1] < size) & (code[1:] < size) & ~edge[1:]
                pairs += np.bincount(code[:-1][both] * size + code[1:][both], minlength=size * size)
                before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                out: list[tuple] = []
                for start, row, token in _runs(data, offs, least):
                    kind = encoding_of(token)
                    codes = (_LUT[kind][np.frombuffer(token.encode(), np.uint8)])[None, :]
                    found = [float(x[0]) for x in battery(codes, len(ALPHABETS[kind]))]
                    out.append((0, ids[lo + row], int(before[start] - before[offs[row]]), len(token), kind, hashlib.sha256(token.encode()).hexdigest()[:16], *found))
                if out:
                    yield _batch(out)
        if pairs.any():
            yield _batch([(1, None, int(i), int(pairs[i]), *[None] * 6) for i in np.flatnonzero(pairs)])

    return docs.select(id64(docs), "text").mapInArrow(run, FOUND)


def _runs(data: np.ndarray, offs: np.ndarray, least: int) -> Iterator[tuple[int, int, str]]:
    """(start, row, characters) of every candidate of a chunk."""
    for table, need, wide in ((_ALNUM, least, False), (_WIDE, least + 4, True)):
        starts, ends, rows = word_spans(data, offs, table)
        for i in np.flatnonzero(ends - starts >= need).tolist():
            token = data[starts[i] : ends[i]].tobytes().decode("ascii")
            if not wide:
                if encoding_of(token):
                    yield int(starts[i]), int(rows[i]), token
            elif not token.isalnum():
                parts = [(0, token)] if encoding_of(token) else [(m.start(), m.group()) for rx in _PARTS for m in rx.finditer(token)]
                for at, part in parts:
                    if len(part) >= need and not part.isalnum() and encoding_of(part):
                        yield int(starts[i]) + at, int(rows[i]), part


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.float64()] * 4]
    names = [x.split()[0] for x in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def text_null(pairs: np.ndarray, strings: int = 1000, seed: int = 5) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of log Fisher over GRID, for text-like strings of each encoding."""
    rng = np.random.default_rng(seed)
    out = {}
    full = pairs.reshape(len(SYMBOLS), len(SYMBOLS))
    other = np.array([SYMBOLS.index(c.swapcase()) for c in SYMBOLS])
    folded = full + full[np.ix_(other, other)]  # text of the other case is as telling
    for name, alphabet in ALPHABETS.items():
        at = [SYMBOLS.index(c) for c in alphabet]
        m = (full if set(alphabet) >= _SETS["base62"] else folded)[np.ix_(at, at)] + 0.5 / len(at)
        steps = np.cumsum(m / m.sum(1, keepdims=True), 1)
        first = np.cumsum(m.sum(1) / m.sum())
        state = np.minimum(np.searchsorted(first, rng.random(strings)), len(at) - 1)
        chain = np.empty((strings, GRID[-1]), np.int64)
        for i in range(GRID[-1]):
            chain[:, i] = state
            state = np.minimum((steps[state] < rng.random(strings)[:, None]).sum(1), len(at) - 1)
        logs = [np.log(battery(chain[:, :n], len(at))[3] + 1e-9) for n in GRID]
        out[name] = (np.array([x.mean() for x in logs]), np.array([max(x.std(), 0.05) for x in logs]))
    return out


def discoveries(counts: list[tuple[str, int, int, int]], q: float, per_decade: int) -> dict[tuple[str, int], int]:
    """Benjamini-Hochberg in each stratum, from (encoding, length class, bin, count): the first bin that is discovered."""
    strata: dict[tuple[str, int], dict[int, int]] = {}
    for e, s, b, n in counts:
        strata.setdefault((e, s), {})[b] = n
    out = {}
    for key, bins in strata.items():
        total, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / per_decade) <= q * seen / total:  # the largest p of the bin
                out[key] = b
    return out


def scan(docs: DataFrame, least: int = 16, q: float = 0.05, alpha: float = 1e-3, per_decade: int = 20) -> DataFrame:
    """(doc_id, start, length, encoding, fingerprint, z values, p_random, p_text) of each finding; start counts characters."""
    got = cut(candidates(docs, least))
    pairs = np.zeros(len(SYMBOLS) ** 2, np.int64)
    for i, n in got.where("kind = 1").groupBy("start").agg(F.sum("length")).collect():  # at most symbols squared rows
        pairs[i] = n
    null = text_null(pairs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, kinds, fisher = b.column(2).to_numpy(), b.column(3).to_pylist(), b.column(8).to_numpy()
            x = np.log(np.minimum(n, GRID[-1]))
            mean = np.array([np.interp(v, np.log(GRID), null[k][0]) for v, k in zip(x, kinds)])
            dev = np.array([np.interp(v, np.log(GRID), null[k][1]) for v, k in zip(x, kinds)])
            p = _tail(-(np.log(fisher + 1e-9) - mean) / dev)
            bin_ = np.floor(-np.log10(np.clip(p, 1e-15, 1)) * per_decade).astype(np.int32)
            stratum = np.searchsorted(GRID, n, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(random_p(fisher)), pa.array(p), pa.array(stratum), pa.array(bin_)], names=["doc_id", "start", "length", "encoding", "fingerprint", "chi_z", "runs_z", "serial_z", "p_random", "p_text", "stratum", "bin"])

    judged = got.where("kind = 0").select("doc_id", "start", "length", "encoding", "fingerprint", "chi_z", "runs_z", "serial_z", "fisher").mapInArrow(judge, "doc_id bigint, start bigint, length bigint, encoding string, fingerprint string, chi_z double, runs_z double, serial_z double, p_random double, p_text double, stratum int, bin int")
    # At most encodings x length classes x bins rows.
    counts = [tuple(r) for r in judged.groupBy("encoding", "stratum", "bin").count().collect()]
    least_bin = F.lit(None).cast("int")
    for (e, s), b in sorted(discoveries(counts, q, per_decade).items()):
        least_bin = F.when((F.col("encoding") == e) & (F.col("stratum") == s), b).otherwise(least_bin)
    return judged.where((F.col("bin") >= least_bin) & (F.col("p_random") >= alpha)).drop("stratum", "bin")
