"""Quality rules from tokeniser fertility.

Two public vocabularies are run over every whole text: SentencePiece with byte
fallback, and a byte-level one for many languages. Per document and vocabulary:
characters per token and the share of tokens that are no whole characters; under
the first one also the token entropy, normalised by the entropy that as many
distinct tokens would have. Rejection bands are Tukey fences over all documents
of a language (of a script where the language is missing) and of a size class, as
entropy depends on length; groups under ``min_group`` documents use the fences of
their own language over their size class and the two beside it. Where that is
under ``min_group`` too, there is too little evidence to say what is usual, so
nothing is rejected: other languages never judge a document.

Fences are one row per language and size class. They go to every task up to
``send`` rows and are joined by a shuffle beyond.

Defined results: null, empty and blank texts and texts under ``min_tokens``
tokens have too little evidence and are kept, as are those of groups without
fences; a null doc_id is carried along; repeated rows get equal results; an empty
table gives an empty result; other columns are not looked at. doc_id is read as
a 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import pieces
from quillsift.llm.common import cut, i64, id64, rows_of, without

METRICS = "doc_id bigint, text_hash bigint, band string, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, chars_per_token_2 double, byte_share_2 double"
SCRIPTS = (("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Devanagari", 0x900, 0x97F), ("Thai", 0xE00, 0xE7F), ("Hangul", 0xAC00, 0xD7AF), ("Kana", 0x3040, 0x30FF), ("Han", 0x4E00, 0x9FFF))


def script_of_text(text: str | None) -> str:
    """The script with most characters; Other where none has any."""
    cps = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    counts = [int(((cps >= lo) & (cps <= hi)).sum()) for _, lo, hi in SCRIPTS]
    return SCRIPTS[int(np.argmax(counts))][0] if max(counts) else "Other"


def entropies(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Token entropy of each document over that of as many distinct tokens; 1 under two tokens."""
    n = np.diff(offs)
    code = np.sort(np.repeat(np.arange(len(n), dtype=np.int64) << 16, n) | ids)
    at = np.flatnonzero(np.diff(code, prepend=-1))
    counts = np.diff(np.append(at, len(code)))
    clogc = np.bincount(code[at] >> 16, counts * np.log2(counts), len(n))
    safe = np.maximum(n, 1)
    return np.where(n > 1, (np.log2(safe) - clogc / safe) / np.log2(np.maximum(n, 2)), 1.0)


def measure(docs: DataFrame, model: str = pieces.DEFAULT_MODEL, second: str = pieces.SECOND_MODEL) -> DataFrame:
    """One narrow row per document with its fertility metrics; a single pass, no shuffle."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    src = docs.select(id64(docs), "text", F.xxhash64("text").alias("text_hash"), F.nullif(F.trim(lang), F.lit("")).alias("lang"))
    per = lambda x, n: pa.array(np.where(n > 0, x / np.maximum(n, 1), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in rows_of(b):
                part = b.slice(lo, hi - lo)
                ids, at, chars, broken = pieces.encode_docs(data, offs, model)
                n2, _, broken2 = pieces.measure_docs(data, offs, second)
                n = np.diff(at)
                bands = [f"lang:{x}" if x is not None else "script:" + script_of_text(part.column(1)[i].as_py()) for i, x in enumerate(part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bands, pa.string()), i64(n), per(chars, n), per(broken, n), pa.array(entropies(ids, at)), per(chars, n2), per(broken2, n2)], names=[x.split()[0] for x in METRICS.split(", ")])

    return src.mapInArrow(run, METRICS)


#: metric, least spread, reasons below and above the fences
RULES = (
    ("chars_per_token", 0.04, "fertility_low", "fertility_high"), ("byte_share", 0.01, None, "byte_fallback"), ("token_entropy", 0.01, "entropy_low", "entropy_high"),
    ("chars_per_token_2", 0.04, "fertility_low_2", "fertility_high_2"), ("byte_share_2", 0.01, None, "byte_fallback_2"),
)


def decide(metrics: DataFrame, min_tokens: int = 24, min_group: int = 100, width: float = 3.0, send: int = 100_000) -> DataFrame:
    """metrics with size_class, keep and reason. Quantiles are exact, over values rounded to 1/2000."""
    step = lambda c: F.round(F.col(c) * 2000) / 2000
    m = metrics.withColumn("size_class", F.least(F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) / 1.5), F.lit(12)).cast("int"))
    enough = m.where(F.col("n_tokens") >= min_tokens)
    aggs = [F.count(F.lit(1)).alias("n"), *[F.percentile(step(c), F.array(F.lit(0.25), F.lit(0.75))).alias(f"q{i}") for i, (c, *_) in enumerate(RULES)]]
    groups = cut(enough.groupBy("band", "size_class").agg(*aggs))
    small = groups.count() <= send
    sent = lambda d: F.broadcast(d) if small else d
    few = groups.where(F.col("n") < min_group).select("band", "size_class")
    around = enough.withColumn("size_class", F.explode(F.array(*[F.col("size_class") + i for i in (-1, 0, 1)]))).join(sent(few), ["band", "size_class"], "left_semi")
    fences = groups.where(F.col("n") >= min_group).unionByName(around.groupBy("band", "size_class").agg(*aggs).where(F.col("n") >= min_group))
    j = m.join(sent(fences.drop("n")), ["band", "size_class"], "left")
    reason = F.when(F.col("n_tokens") < min_tokens, None)
    for i, (c, least, below, above) in enumerate(RULES):
        lo, hi = F.col(f"q{i}")[0], F.col(f"q{i}")[1]
        wide = F.greatest(hi - lo, F.lit(least)) * width
        if below:
            reason = reason.when(F.col(c) < lo - wide, below)
        reason = reason.when(F.col(c) > hi + wide, above)
    return j.withColumn("reason", reason).withColumn("keep", F.col("reason").isNull()).select(*metrics.columns, "size_class", "keep", "reason")


def quality_rules(docs: DataFrame, model: str = pieces.DEFAULT_MODEL, **bands) -> DataFrame:
    """doc_id, metrics, keep and reason of every document."""
    return decide(cut(measure(docs, model)), **bands).drop("text_hash")


def accepted(docs: DataFrame, model: str = pieces.DEFAULT_MODEL, **bands) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns."""
    bad = decide(cut(measure(docs, model)), **bands).where(~F.col("keep")).select("doc_id", "text_hash").distinct()
    return without(docs, bad)

