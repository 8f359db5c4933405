"""File trees as DataFrames, and sinks that never rewrite in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import columns as C
from quillsift.functions import taxonomy as T
from quillsift.functions import udfs as U
from quillsift.operators import inspection
from quillsift.sources import containers

SKIPPED = (".git", ".hg", ".svn", ".tox", ".nox", ".venv", "venv", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build")
MAX_FILES = 10_000
MAX_TOTAL = 256 << 20


def skipped(path: F.Column) -> F.Column:
    return path.rlike("(?:^|/)(?:" + "|".join(s.replace(".", "\\.") for s in SKIPPED) + ")/")


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content below a root; contents are read only where selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.where(~skipped(F.col("path")))


def expand(paths: DataFrame) -> DataFrame:
    """Each path once, without skipped directories."""
    return paths.where(~skipped(F.col("path"))).dropDuplicates(["path"])


def check_budget(files: DataFrame, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL) -> list[str]:
    """What is over the limits of one interactive operation; jobs on a cluster pass larger ones."""
    n, size = files.agg(F.count(F.lit(1)), F.sum("length")).first()
    out = [f"{n} files; limit is {max_files}"] if n > max_files else []
    return out + ([f"{size} bytes; limit is {max_total}"] if n > 1 and (size or 0) > max_total else [])


MAX_TEXT_BYTES = 4 * T.MAX_TEXT
KINDS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "pdf": "pdf", "svg": "svg", "docx": "office", "xlsx": "office", "pptx": "office"}


def classified(files: DataFrame) -> DataFrame:
    """Adds fmt (null for text), profile and whether the file is over the limit of its kind.

    Contents over the container limit are never read; their kind is told by their suffix.
    """
    huge = F.col("length") > containers.CONTAINER_LIMIT
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by_name = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[suffix]
    content = F.when(~huge, F.col("content"))
    fmt = F.when(huge, by_name).otherwise(C.detect_format(content, F.col("path")))
    r = files.select("path", "length", content.alias("content"), fmt.alias("fmt"), C.infer_profile(F.col("path")).alias("profile"))
    return r.withColumn("oversize", F.when(F.col("fmt").isNull(), F.col("length") > MAX_TEXT_BYTES).otherwise(F.col("length") > containers.CONTAINER_LIMIT))


def texts(files: DataFrame) -> DataFrame:
    """(path, profile, text, oversize) of the files that are no containers; invalid UTF-8 becomes U+FFFD, line ends stay. Text over the limit is null."""
    c = classified(files).where("fmt IS NULL")
    return c.select("path", "profile", F.when(~F.col("oversize"), F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), "oversize")


def _parsed(c: DataFrame) -> DataFrame:
    """Adds metadata and its status; only contents that the JVM takes for containers go to Python."""
    inside = F.col("fmt").isNotNull() & ~F.col("oversize")
    m = U.parse_metadata(F.when(inside, F.col("content")), F.col("path"))["metadata"]
    limit = F.create_map(F.concat("fmt", F.lit(".parse_status")), F.lit("resource_limit"), F.concat("fmt", F.lit(".warning.container_limit")), F.concat(F.col("length").cast("string"), F.lit(" bytes")))
    return c.withColumn("metadata", F.when(F.col("fmt").isNull(), F.create_map().cast("map<string,string>")).when(F.col("oversize"), limit).otherwise(m))


def metadata(files: DataFrame) -> DataFrame:
    """(path, fmt, metadata, parse_status, coverage, warnings, refusal_reasons) of containers."""
    m = _parsed(classified(files).where("fmt IS NOT NULL")).select("path", "fmt", "metadata")
    return m.select("*", *[c.alias(n) for n, c in C.lifted(F.col("metadata"), F.col("fmt")).items()])


def inspect(files: DataFrame) -> DataFrame:
    """path, kind, findings, total, parse_status, warnings, substantive metadata and what can't be determined, of every file, in one pass.

    Files over the limit of their kind have status resource_limit and no findings. The text of an SVG is scanned for characters.
    """
    c = _parsed(classified(files))
    kind = F.coalesce("fmt", F.lit("text"))
    text = F.when(F.col("fmt").isNull() & ~F.col("oversize"), F.make_valid_utf8(F.col("content").cast("string")))
    drawn = U.svg_text(F.when((F.col("fmt") == "svg") & ~F.col("oversize"), F.col("content")))
    none = F.array().cast(f"array<{U.FINDING}>")
    lift = C.lifted(F.col("metadata"), kind)
    c = c.withColumn("_t", U.inspected(text)).withColumn("_s", U.codepoint_findings(drawn))
    over = F.array(F.concat(F.col("length").cast("string"), F.lit(f" bytes; the text limit is {MAX_TEXT_BYTES}")))
    c = c.select(
        "path", kind.alias("kind"), F.coalesce("_t.findings", "_s", none).alias("findings"),
        F.when(F.col("fmt").isNotNull(), lift["parse_status"]).when(F.col("oversize"), "resource_limit").otherwise(F.col("_t.parse_status")).alias("parse_status"),
        lift["coverage"].alias("coverage"), F.when(F.col("fmt").isNotNull(), lift["warnings"]).when(F.col("oversize"), over).otherwise(F.col("_t.warnings")).alias("warnings"), "metadata",
    )
    return c.select("path", "kind", "findings", F.size("findings").cast("bigint").alias("total"), "parse_status", "warnings", C.substantive(F.col("metadata")).alias("metadata"), C.notices(F.col("kind"), F.col("metadata"), F.col("parse_status")).alias("undeterminable"))


def clean_to(files: DataFrame, out: str) -> DataFrame:
    """Cleaned texts as a new dataset, after all files were seen to be cleanable; containers and texts over the limit stop the job before a byte is written."""
    refused = classified(files).where("fmt IS NOT NULL OR oversize").select("path", "fmt").limit(20).collect()
    if refused:
        raise ValueError("can't be rewritten: " + ", ".join(f"{r.path} ({r.fmt or 'over the text limit'})" for r in refused))
    t = texts(files)
    got = inspection.clean(t.drop("oversize"), F.col("profile"))
    got.write.mode("errorifexists").parquet(out)
    return files.sparkSession.read.parquet(out)
