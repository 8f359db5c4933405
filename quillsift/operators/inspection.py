"""Inspection and cleaning as DataFrame operators over (key columns, text)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.functions import columns as C
from quillsift.functions import kernels as K
from quillsift.functions import reports as R
from quillsift.functions import taxonomy as T
from quillsift.functions import udfs as U


def category_dim(spark) -> DataFrame:
    return spark.createDataFrame([(c, s, T.RANKS[s]) for c, s in sorted(T.CATEGORIES.items())], "category string, severity string, rank int")


def codepoint_ranges(spark) -> DataFrame:
    """164 ranges: every flagged code point with its category."""
    return spark.createDataFrame(list(T.category_ranges()), "lo int, hi int, category string")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a scan has fewer splits, as one large row group is one task; many splits stay as they are.

    A plan that shuffles has as many tasks as it needs already, and counting them would run it.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def findings(docs: DataFrame, text: str = "text", width: int = 24) -> DataFrame:
    """One row per finding, beside all columns but the text; every finding of every text, of any length.

    Texts without candidates are filtered out in the JVM. explode_outer, as for explode Spark
    infers a filter on the function's result and evaluates it twice.
    """
    keys = [F.col(f"`{c}`") for c in docs.columns if c != text]
    hot = spread(docs.where(C.is_candidate(F.col(text))))
    f = hot.select(*keys, F.explode_outer(U.all_findings(F.col(text), F.lit(width))).alias("_f"))
    return f.where("_f IS NOT NULL").select(*keys, "_f.*")


def code_points(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each non-printable or non-ASCII character occurs: exploded, then combined in each task before the shuffle."""
    hot = docs.where(C.is_candidate(F.col(text)))
    chars = hot.select(F.explode(F.split(text, "")).alias("ch")).where(F.col("ch").rlike(T.CANDIDATE))
    return chars.groupBy("ch").agg(F.count(F.lit(1)).alias("n")).withColumn("codepoint", F.ascii("ch"))


def categorised(points: DataFrame) -> DataFrame:
    """Adds category and severity. Rows are distinct characters, so the 164 ranges may be looped over."""
    dim = F.broadcast(codepoint_ranges(points.sparkSession))
    return points.join(dim, points["codepoint"].between(dim["lo"], dim["hi"]), "left").drop("lo", "hi").withColumn("severity", C.severity_of(F.col("category")))


def reports(docs: DataFrame, text: str = "text", kind: str = "text") -> DataFrame:
    """One report per document: findings, counts, status, warnings and what was not evaluated."""
    r = spread(docs).withColumn("_r", U.inspected(F.col(text)))
    f = F.col("_r.findings")
    count = lambda key: lambda v: F.struct(v.alias(key), F.size(F.filter(f, lambda x: x[key] == v)).cast("bigint").alias("n"))
    cats = F.transform(F.array_distinct(F.transform(f, lambda x: x["category"])), count("category"))
    by_category = F.transform(F.array_sort(F.transform(cats, lambda x: F.struct((-x["n"]).alias("k"), x["category"].alias("category"), x["n"].alias("n")))), lambda x: F.struct(x["category"].alias("category"), x["n"].alias("n")))
    by_severity = F.transform(F.array_distinct(F.transform(f, lambda x: x["severity"])), count("severity"))
    return r.select(
        *[c for c in docs.columns if c != text],
        F.lit(kind).alias("kind"), f.alias("findings"), by_category.alias("counts_by_category"), by_severity.alias("counts_by_severity"), F.size(f).cast("bigint").alias("total"),
        F.array_max(F.transform(f, lambda x: C.rank_of(x["severity"]))).alias("top_rank"),
        F.col("_r.parse_status").alias("parse_status"), F.lit(R.TEXT_COVERAGE).alias("coverage"), F.col("_r.warnings").alias("warnings"),
        F.array(F.struct(F.lit(R.WATERMARK[0]).alias("claim"), F.lit(R.WATERMARK[1]).alias("reason"))).alias("undeterminable"),
    )


def report_dict(found: K.Inspection, source: str, kind: str = "text") -> dict:
    """The report of one document as nested plain values."""
    return R.body(source, kind, R.verifiable(found.findings, {}, R.status(found.parse_status, warnings=found.warnings)), [R.WATERMARK])


@U._native("string")
def _json(text: pa.Array, source: pa.Array) -> pa.Array:
    return pa.array([None if t is None else json.dumps(report_dict(K.inspect(t), s), ensure_ascii=True) for t, s in zip(text.to_pylist(), source.to_pylist())], pa.string())


def report_json(docs: DataFrame, source: str, text: str = "text") -> DataFrame:
    """The source column and each document's report as ASCII-only JSON."""
    return docs.select(source, _json(F.col(text), F.col(source).cast("string")).alias("json"))


def clean(docs: DataFrame, profile: F.Column | str = "prose", text: str = "text") -> DataFrame:
    """docs with text cleaned, and removed, folded, normalized, transformed and changed beside it."""
    p = F.lit(profile) if isinstance(profile, str) else profile
    r = spread(docs).withColumn("_r", U.cleaned(F.col(text), p))
    counts = [F.col(f"_r.{c}").cast("bigint").alias(c) for c in ("removed", "folded", "normalized")]
    total = sum((F.col(f"_r.{c}").cast("bigint") for c in ("folded", "normalized")), F.col("_r.removed").cast("bigint"))
    return r.select(*[c for c in docs.columns if c != text], F.col("_r.cleaned").alias(text), *counts, total.alias("transformed"), F.col("_r.changed").alias("changed"), F.col("_r.parse_status").alias("parse_status"))
