"""Quality and toxicity scores from random Fourier features.

Document statistics of whole texts (lengths, character classes, repetition and
the weight of words that a first part of the labelled rows found telling) pass
through random Fourier features, which approximate a Gaussian kernel. Each
partition of the training rows sums its normal equations; their total fits one
ridge regression per label, and isotonic regression on held-out rows turns
scores into probabilities.

The classifier is fitted on at most ``max_labelled`` labelled rows, those with
the least hash of doc_id; the bound is a parameter. Half of them find the words,
a quarter fits the ridge, a quarter calibrates. Scoring covers every document.

Defined results: null, empty and blank texts have all statistics 0 and are
scored as such; several labels of a doc_id count as their worst (quality 0,
toxic 1); null labels and labels of unknown documents are ignored; without any
usable label the scores are null and every document is kept; rows that repeat
get equal scores; of several texts of a labelled doc_id the least is fitted; other
columns are not looked at. doc_id must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import SPACE_SPLIT, WORDS, byte_class, cut, id64, mix64, rows_of, word_hashes, word_spans

HEADS = ("quality", "toxic")
_CLASS = np.zeros(256, np.int64)
for _i, _rx in enumerate((rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[.,;:?'\"()-]", rb"[!-/:-@\[-`{-~]", rb"[\t\r ]", rb"\n", rb"[\x80-\xff]")):
    _CLASS[byte_class(_rx) & ((_CLASS == 0) if _i else True)] = _i + 1
CLASSES = 9
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NAMES = tuple(f"class_{i}" for i in range(CLASSES)) + ("log_bytes", "log_words", "word_bytes", "distinct", "top_word", "adjacent", "quality_mean", "quality_low", "toxic_sum", "toxic_max", "toxic_hits")


@dataclass
class Lexicon:
    """Sorted word hashes with the log odds that a word says something of each label."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    quality: np.ndarray = field(default_factory=lambda: np.zeros(0))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def weights(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(h)), np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        return np.where(hit, self.quality[at], 0.0), np.where(hit, self.toxic[at], 0.0)


def doc_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _LOWER[data]
    starts, ends, rows = word_spans(low, offs, WORDS)
    return word_hashes(low, starts, ends), rows


def doc_terms(data: np.ndarray, offs: np.ndarray, stem: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """What the lexicon weighs: the words, and the first bytes of longer words, as inflected forms share them."""
    low = _LOWER[data]
    starts, ends, rows = word_spans(low, offs, WORDS)
    long = ends - starts > stem
    stems = mix64(word_hashes(low, starts[long], starts[long] + stem))
    return np.concatenate([word_hashes(low, starts, ends), stems]), np.concatenate([rows, rows[long]])


def statistics(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of NAMES per document."""
    n, size = len(offs) - 1, np.diff(offs)
    out = np.zeros((n, len(NAMES)))
    rows = np.repeat(np.arange(n), size)
    out[:, :CLASSES] = np.bincount(rows * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(size, 1)[:, None]
    h, owner = doc_words(data, offs)
    words = np.bincount(owner, minlength=n)
    safe = np.maximum(words, 1)
    tokens = np.bincount(word_spans(data, offs, SPACE_SPLIT)[2], minlength=n)
    out[:, CLASSES] = np.log1p(size)
    out[:, CLASSES + 1] = np.log1p(words)
    out[:, CLASSES + 2] = np.minimum(size / np.maximum(tokens, 1), 50)
    if len(h):
        order = np.lexsort((h, owner))
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(owner[order]) != 0)
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(h)))
        who = owner[order][at]
        out[:, CLASSES + 3] = np.bincount(who, minlength=n) / safe
        top = np.zeros(n)
        np.maximum.at(top, who, counts)
        out[:, CLASSES + 4] = top / safe
        same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        out[:, CLASSES + 5] = np.bincount(owner[1:][same], minlength=n) / safe
        h, owner = doc_terms(data, offs)
        q, t = lexicon.weights(h)
        out[:, CLASSES + 6] = np.bincount(owner, q, n) / safe
        out[:, CLASSES + 7] = np.bincount(owner, np.minimum(q, 0), n) / safe
        out[:, CLASSES + 8] = np.log1p(np.bincount(owner, np.maximum(t, 0), n))
        most = np.zeros(n)
        np.maximum.at(most, owner, t)
        out[:, CLASSES + 9] = most
        out[:, CLASSES + 10] = np.log1p(np.bincount(owner[t > 0], minlength=n))
    return out


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: list[tuple[np.ndarray, np.ndarray]]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequencies + self.phase)
        return np.concatenate([f, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        return np.stack([np.interp(r[:, i], *self.steps[i]) for i in range(len(HEADS))], 1)


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots for interpolation, shrunk towards the base rate by one row."""
    order = np.argsort(score)
    base = float((label * weight).sum() / weight.sum())
    pools: list[list[float]] = []  # sum, weight, lowest and highest score
    for s, y, w in zip(score[order], label[order], weight[order]):
        pools.append([y * w, w, s, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a, b = pools[-2], pools.pop()
            pools[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    x = np.array([v for p in pools for v in (p[2], p[3])])
    y = np.array([(p[0] + base) / (p[1] + 1) for p in pools for _ in range(2)])
    return x, np.maximum.accumulate(y)


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, text, quality, toxic, part) of at most max_labelled documents; part 0 to 3 by hash."""
    y = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("_y")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    y = y.withColumn("_o", F.xxhash64("_y")).orderBy("_o", "_y").limit(max_labelled)
    # The sample is bounded by max_labelled, so it may be sent to every task.
    d = docs.select("doc_id", "text").join(F.broadcast(y), docs["doc_id"] == y["_y"])
    d = d.groupBy("doc_id", "quality", "toxic", "_o").agg(F.min("text").alias("text"))  # of several texts of one doc_id the least
    return cut(d.select("doc_id", "text", "quality", "toxic", F.pmod(F.shiftright("_o", 8), F.lit(4)).cast("int").alias("part")))


def find_words(sample: DataFrame, least: int = 5, most: int = 20_000) -> Lexicon:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, t = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            for lo, _, data, offs in rows_of(b, "text"):
                h, owner = doc_terms(data, offs)
                pair = np.unique(np.stack([h, owner.astype(np.uint64)], 1), axis=0)
                who = lo + pair[:, 1].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy().view(np.int64)), pa.array(1 - q[who]), pa.array(t[who])], names=["h", "bad", "toxic"])

    part = sample.where("part < 2")
    got = part.select("text", "quality", "toxic").mapInArrow(run, "h bigint, bad bigint, toxic bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.sum("toxic").alias("toxic")).where(F.col("n") >= least)
    total = part.agg(F.count(F.lit(1)), F.sum(F.lit(1) - F.col("quality")), F.sum("toxic")).first()
    n, bad, toxic = (float(x or 0) for x in total)

    def odds(k: str, all_k: float) -> tuple[F.Column, F.Column]:
        p, q = (F.col(k) + 0.5) / (all_k + 1), (F.col("n") - F.col(k) + 0.5) / (n - all_k + 1)
        w = F.log(p / q)
        return w, w / F.sqrt(1 / (F.col(k) + 0.5) + 1 / (F.col("n") - F.col(k) + 0.5))

    (wb, zb), (wt, zt) = odds("bad", bad), odds("toxic", toxic)
    # Over the vocabulary of the sample chance alone gives |z| of 4 now and then.
    got = got.select("h", F.when(F.abs(zb) > 4, -wb).otherwise(0.0).alias("q"), F.when(zt > 4, wt).otherwise(0.0).alias("t"), F.greatest(F.abs(zb), zt).alias("z")).where("q <> 0 OR t <> 0")
    a = got.orderBy(F.desc("z"), "h").limit(most).toArrow()
    h = a.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Lexicon(h[order], a.column("q").to_numpy()[order], a.column("t").to_numpy()[order])


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'Y of (x, quality, toxic) rows: each partition sums its own, then the sums are added."""
    d = len(model.phase) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((d, d + len(HEADS)))
        for b in batches:
            x, y = _xy(b)
            z = model.features(x)
            a += z.T @ np.concatenate([z, y], 1)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()])], names=["a"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((d, d + len(HEADS)))
        for b in batches:
            for raw in b.column(0).to_pylist():
                a += np.frombuffer(raw).reshape(a.shape)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()])], names=["a"])

    total = rows.mapInArrow(part, "a binary").repartition(1).mapInArrow(add, "a binary").first()
    a = np.frombuffer(total[0]).reshape(d, -1)
    return a[:, :d], a[:, d:]


def _xy(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(b.column(0).to_pylist(), np.float64).reshape(b.num_rows, len(NAMES))
    return x, np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2)], 1)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, features: int = 256, ridge: float = 1e-4, seed: int = 11) -> Model | None:
    sample = labelled(docs, labels, max_labelled)
    lexicon = find_words(sample)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in rows_of(b):
                p = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(list(statistics(data, offs, lexicon)), pa.list_(pa.float64())), p.column(1), p.column(2), p.column(3)], names=["x", "quality", "toxic", "part"])

    rows = cut(sample.select("text", "quality", "toxic", "part").mapInArrow(stats, "x array<double>, quality int, toxic int, part int"))
    train = rows.where("part = 2")
    if train.limit(1).count() == 0:
        train = rows  # too few rows to split
    agg = train.agg(F.count(F.lit(1)), *[f(F.col("x")[i]) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]).first()
    if not agg[0]:
        return None
    moments = np.array([0.0 if v is None else v for v in agg[1:]]).reshape(-1, 2)
    rng = np.random.default_rng(seed)
    gamma = 1 / len(NAMES)
    model = Model(lexicon, moments[:, 0], np.maximum(moments[:, 1], 1e-3), rng.normal(0, np.sqrt(gamma), (len(NAMES), features)), rng.uniform(0, 2 * np.pi, features), np.zeros((features + 1, len(HEADS))), [])
    a, y = normal_equations(train.select("x", "quality", "toxic"), model)
    model.weights = np.linalg.solve(a + ridge * agg[0] * np.eye(len(a)), y)
    held = rows.where("part = 3")
    if held.limit(1).count() == 0:
        held = train

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _xy(b)
            r = model.raw(x)
            for i in range(len(HEADS)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(np.round(r[:, i], 3)), pa.array(y[:, i])], names=["head", "score", "label"])

    bins = held.select("x", "quality", "toxic").mapInArrow(scored, "head int, score double, label double").groupBy("head", "score").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()
    for i in range(len(HEADS)):
        b = bins[bins["head"] == i]
        model.steps.append(isotonic(b["score"].to_numpy(), b["y"].to_numpy(), b["n"].to_numpy(np.float64)))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, quality, toxic, keep) of every document."""
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(id64(docs), nothing.alias("quality"), nothing.alias("toxic"), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the features and by most words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in rows_of(b):
                p = sent.value.calibrated(statistics(data, offs, sent.value.lexicon))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["doc_id", "quality", "toxic"])

    out = docs.select(id64(docs), "text").mapInArrow(run, "doc_id bigint, quality double, toxic double")
    return out.withColumn("keep", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))


def quality_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return score(docs, fit(docs, labels, **how))
