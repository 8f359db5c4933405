"""Queries over the driver tables and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import columns as C
from quillsift.functions import taxonomy as T
from quillsift.functions import udfs as U
from quillsift.operators import audit, inspection
from quillsift.plans import oracle as O
from quillsift.plans import pins, samples
from quillsift.plans.dirty import dirty
from quillsift.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, Callable[[], str]] = {}


def query(sql: Callable[[], str] | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _ORACLES[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: make() for k, make in _ORACLES.items()}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", *extra, F.expr(dirty()).alias("text"))


def _long(c: str) -> F.Column:
    return F.col(c).cast("bigint").alias(c)


# --- classification ---------------------------------------------------------------


@query(lambda: f"WITH {O.dimensions()} SELECT category, severity, CAST(rank AS BIGINT) AS rank FROM dim")
def category_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.category_dim(spark).select("category", "severity", _long("rank"))


@query(lambda: f"WITH {O.dimensions()} SELECT severity, list_sort(list(category)) AS categories FROM dim GROUP BY severity")
def categories_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.category_dim(spark).groupBy("severity").agg(F.array_sort(F.collect_list("category")).alias("categories"))


@query(lambda: O.characters() + "SELECT c AS ch, CAST(cp AS BIGINT) AS codepoint, category, severity, count(*) AS n FROM f WHERE regexp_matches(c, '[^\\t\\n\\r\\x20-\\x7e]') GROUP BY 1, 2, 3, 4")
def codepoint_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-ASCII character with its category; no Python in the plan."""
    got = inspection.categorised(inspection.code_points(_docs(spark, sf_dir)))
    return got.select("ch", _long("codepoint"), "category", "severity", "n")


@U._arrow("struct<emoji:boolean,joins:boolean,family:string,barrier:boolean,script:string>")
def _properties(cp: pd.Series) -> pd.DataFrame:
    joins = T.ranges("joins")
    rows = [(T.is_emoji_base(x), x in joins, T.joining_family(x), T.is_barrier(x), T.script_of(x)) for x in cp]
    return pd.DataFrame(rows, columns=["emoji", "joins", "family", "barrier", "script"])


@query(lambda: O.characters() + "SELECT c AS ch, emoji, joins, CASE WHEN family IS NOT NULL THEN family END AS family, barrier, script FROM flags WHERE regexp_matches(c, '[^\\t\\n\\r\\x20-\\x7e]')")
def character_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of each distinct character, computed once per character."""
    points = inspection.code_points(_docs(spark, sf_dir))
    return points.select("ch", _properties("codepoint").alias("p")).select("ch", "p.*")


@query(lambda: O.characters() + ", s AS (SELECT doc_id, list_sort(list(DISTINCT script)) AS scripts FROM f WHERE script <> 'Common' GROUP BY 1) SELECT src.doc_id, coalesce(s.scripts, CASE WHEN regexp_matches(src.text, '[A-Za-z]') THEN ['Latin'] ELSE [] END) AS scripts FROM src LEFT JOIN s USING (doc_id)")
def scripts_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12, in the JVM: one class test per script."""
    marks = [F.when(F.col("text").rlike(T.regex_class(rs)), name) for name, rs in sorted(T.range_sets()["script"].items())]
    return _docs(spark, sf_dir).select("doc_id", F.array_sort(F.array_compact(F.array(*marks))).alias("scripts"))


@query(lambda: f"WITH m(k, v) AS ({O._values(C._compatibility())}), c AS (SELECT doc_id, unnest(range(len(string_split(t, '')))) AS p, unnest(string_split(t, '')) AS ch FROM (SELECT doc_id, {dirty()} AS t FROM documents)) SELECT doc_id, coalesce(string_agg(coalesce(m.v, ch), '' ORDER BY p), '') AS folded FROM c LEFT JOIN m ON m.k = ch GROUP BY doc_id")
def compatibility_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC forms of ASCII, by translation alone."""
    return _docs(spark, sf_dir).select("doc_id", C.fold_compatibility(F.col("text")).alias("folded"))


# --- context and findings -----------------------------------------------------------


@query(lambda: O.characters() + "SELECT doc_id, list_sort(list(CAST(pos AS INTEGER))) AS offsets FROM f WHERE bearing GROUP BY doc_id")
def load_bearing_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L9."""
    d = _docs(spark, sf_dir).where(C.is_candidate(F.col("text")))
    # A filter on a function's result runs the function twice unless it counts as non-deterministic.
    once = U.load_bearing.udf().asNondeterministic()
    return inspection.spread(d).select("doc_id", once("text").alias("offsets")).where(F.size("offsets") > 0)


@query(lambda: f"SELECT doc_id FROM (SELECT doc_id, {dirty()} AS text FROM documents) WHERE regexp_matches(text, '[^\\t\\n\\r\\x20-\\x7e]')")
def candidate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1."""
    return _docs(spark, sf_dir).where(C.is_candidate(F.col("text"))).select("doc_id")


_MIXED = O.WORDS + ", hit AS (SELECT doc_id, pos, cp, category, severity, rank, line, col FROM found UNION ALL SELECT f.doc_id, f.pos, f.cp, 'mixed_script', 'confusable', 4, f.line, f.col FROM runs JOIN f ON f.doc_id = runs.doc_id AND f.pos = runs.suspicious_offsets[1]) "


@query(lambda: O.characters() + _MIXED + "SELECT category, severity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM hit GROUP BY 1, 2")
def findings_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inspection.findings(_docs(spark, sf_dir))
    return f.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(lambda: O.characters() + _MIXED + "SELECT doc_id, CAST(pos AS BIGINT) AS \"offset\", CAST(cp AS BIGINT) AS codepoint, category, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS \"column\" FROM hit")
def findings_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with its place."""
    f = inspection.findings(_docs(spark, sf_dir))
    return f.select("doc_id", _long("offset"), _long("codepoint"), "category", _long("line"), _long("column"))


@query(lambda: O.characters() + O.WORDS + "SELECT doc_id, text AS word, CAST(span_start AS BIGINT) AS span_start, CAST(span_end AS BIGINT) AS span_end, scripts, list_transform(suspicious_offsets, lambda x: CAST(x AS INTEGER)) AS suspicious_offsets FROM runs")
def mixed_script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, I3."""
    d = inspection.spread(_docs(spark, sf_dir).where(C.is_candidate(F.col("text"))))
    r = d.select("doc_id", F.explode_outer(U.suspicious_runs("text")).alias("r")).where("r IS NOT NULL")
    return r.select("doc_id", F.col("r.text").alias("word"), F.col("r.span_start").cast("bigint").alias("span_start"), F.col("r.span_end").cast("bigint").alias("span_end"), "r.scripts", "r.suspicious_offsets")


@query(lambda: O.characters() + _MIXED + ", a AS (SELECT doc_id, count(*) AS total, max(rank) AS top, count(*) FILTER (WHERE severity = 'invisible') AS invisible FROM hit GROUP BY 1) SELECT src.doc_id, coalesce(total, 0) AS total, coalesce(invisible, 0) AS invisible, CAST(top AS BIGINT) AS top_rank, coalesce(top >= 4, false) AS fails_confusable, coalesce(top >= 1, false) AS fails_typographic, CAST(CASE WHEN top >= 5 THEN 1 ELSE 0 END AS BIGINT) AS exit_code, 'complete' AS parse_status FROM src LEFT JOIN a USING (doc_id)")
def document_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report row per document with its threshold tests and exit code."""
    r = inspection.reports(_docs(spark, sf_dir))
    over = lambda s: F.coalesce(F.col("top_rank") >= T.RANKS[s], F.lit(False))
    invisible = F.coalesce(F.get(F.filter("counts_by_severity", lambda x: x["severity"] == "invisible"), F.lit(0))["n"], F.lit(0).cast("bigint"))
    code = C.inspect_exit(F.col("parse_status"), over("invisible"), F.lit(False)).cast("bigint")
    return r.select("doc_id", "total", invisible.alias("invisible"), _long("top_rank"), over("confusable").alias("fails_confusable"), over("typographic").alias("fails_typographic"), code.alias("exit_code"), "parse_status")


@query(lambda: O.characters() + _MIXED + ", c AS (SELECT doc_id, category, count(*) AS n FROM hit GROUP BY 1, 2) SELECT doc_id, list(category ORDER BY n DESC, category) AS categories, list(n ORDER BY n DESC, category) AS counts FROM c GROUP BY doc_id")
def counts_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: most frequent first, then by name."""
    r = inspection.reports(_docs(spark, sf_dir)).where("total > 0")
    return r.select("doc_id", F.col("counts_by_category.category").alias("categories"), F.col("counts_by_category.n").alias("counts"))


@query(lambda: O.characters() + _MIXED + ", a AS (SELECT doc_id, count(*) AS total, max(pos) AS last, count(*) FILTER (WHERE category = 'dash') AS dashes FROM hit GROUP BY 1) SELECT src.doc_id, CAST(src.doc_id AS VARCHAR) AS source, coalesce(total, 0) AS total, last, coalesce(dashes, 0) AS dashes, 'complete' AS parse_status, true AS ascii, 0::BIGINT AS transformed, 'statistical text watermark' AS claim FROM src LEFT JOIN a USING (doc_id)")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII-only JSON per document, read back."""
    j = inspection.report_json(inspection.spread(_docs(spark, sf_dir)), "doc_id")
    schema = "source string, transformed bigint, not_determinable array<struct<claim:string>>, verifiable struct<total:bigint, findings:array<struct<offset:bigint>>, counts_by_category:map<string,bigint>, status:struct<parse_status:string>>"
    j = j.select("doc_id", (~F.col("json").rlike(r"[^\x00-\x7f]")).alias("ascii"), F.from_json("json", schema).alias("r"))
    v = "r.verifiable"
    return j.select("doc_id", "r.source", f"{v}.total", F.array_max(F.col(f"{v}.findings.offset")).alias("last"), F.coalesce(F.try_element_at(F.col(f"{v}.counts_by_category"), F.lit("dash")), F.lit(0)).cast("bigint").alias("dashes"), F.col(f"{v}.status.parse_status").alias("parse_status"), "ascii", "r.transformed", F.col("r.not_determinable")[0]["claim"].alias("claim"))


@query(lambda: O.characters() + ", n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY 1) SELECT l.quality, l.toxic, count(*) AS docs, CAST(sum(coalesce(n.n, 0)) AS BIGINT) AS findings FROM labels l JOIN documents d USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1, 2")
def hygiene_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings joined to labels, on narrow rows: texts are reduced to counts before the join."""
    d = inspection.spread(_docs(spark, sf_dir))
    n = F.when(C.is_candidate(F.col("text")), F.size(U.codepoint_findings(F.when(C.is_candidate(F.col("text")), F.col("text"))))).otherwise(0)
    counts = d.select("doc_id", n.cast("bigint").alias("n"))
    j = _table(spark, sf_dir, "labels").join(counts, "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("findings"))


@query(lambda: O.characters() + "SELECT d.lang, f.category, count(*) AS n FROM found f JOIN documents d USING (doc_id) GROUP BY CUBE (d.lang, f.category)")
def findings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "lang").where(C.is_candidate(F.col("text")))
    f = inspection.spread(d).select("lang", F.explode_outer(U.codepoint_findings("text")).alias("f")).where("f IS NOT NULL").select("lang", "f.category")
    return f.cube("lang", "category").agg(F.count(F.lit(1)).alias("n"))


# --- cleaning -------------------------------------------------------------------------


@query(lambda: O.characters() + "SELECT doc_id, text, removed FROM stripped")
def strip_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel for texts with candidates, nothing for the rest."""
    t = F.col("text")
    hot = C.is_candidate(t)
    r = inspection.spread(_docs(spark, sf_dir)).withColumn("r", U.strip_invisible(F.when(hot, t)))
    return r.select("doc_id", F.when(hot, F.col("r.text")).otherwise(t).alias("text"), F.when(hot, F.col("r.removed")).otherwise(0).cast("bigint").alias("removed"))


def _fold_query(profile: str) -> tuple[Query, Callable[[], str]]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = F.col("text")
        out = C.fold_spaces(t) if profile == "prose" else C.fold_typography(t)
        return _docs(spark, sf_dir).select("doc_id", out.alias("text"), C.folded_count(t, profile).alias("folded"))

    return run, lambda: f"WITH src AS (SELECT doc_id, {dirty()} AS text FROM documents) SELECT doc_id, {O.fold_sql('text', profile)} AS text, {O.folded_sql('text', profile)} AS folded FROM src"


def _cleaned_sql(profile: str) -> str:
    """Up to `z`: what cleaning makes of every text, with its addresses left alone."""
    given = dirty()
    ends = "text"
    norm = "0"
    if profile == "data":
        given, ends = f"CASE WHEN starts_with({dirty()}, chr(65279)) THEN substr({dirty()}, 2) ELSE {dirty()} END", "replace(text, chr(13) || chr(10), chr(10))"
        norm = f"(len(s.text) - len(replace(s.text, chr(13) || chr(10), chr(10)))) + CASE WHEN starts_with(o.t, chr(65279)) THEN 1 ELSE 0 END"
    return O.characters(text=given) + (
        f", o AS (SELECT doc_id, {dirty()} AS t FROM documents), e AS (SELECT doc_id, {ends} AS text FROM stripped)" + O.folded_outside("e", profile)
        + f", z AS (SELECT s.doc_id, o.t, f.text, s.removed, f.folded, CAST({norm} AS BIGINT) AS normalized FROM stripped s JOIN o USING (doc_id) JOIN folded_text f USING (doc_id)) "
    )


def _clean_query(profile: str) -> tuple[Query, Callable[[], str]]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inspection.clean(_docs(spark, sf_dir), profile).drop("parse_status")

    return run, lambda: _cleaned_sql(profile) + "SELECT doc_id, text, removed, folded, normalized, removed + folded + normalized AS transformed, text <> t AS changed FROM z"


for _profile in ("prose", "code"):
    for _name, _make in (("fold", _fold_query), ("clean", _clean_query)):
        _run, _sql = _make(_profile)
        _QUERIES[f"{_name}_{_profile}"], _ORACLES[f"{_name}_{_profile}"] = _run, _sql
_QUERIES["clean_data"], _ORACLES["clean_data"] = _clean_query("data")


@query(lambda: _cleaned_sql("prose") + "SELECT CAST(max(CASE WHEN text <> t THEN 1 ELSE 0 END) AS BIGINT) AS exit_code, count(*) FILTER (WHERE text <> t) AS changed FROM z")
def clean_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether cleaning would change anything."""
    return inspection.clean(_docs(spark, sf_dir)).agg(F.max(F.col("changed").cast("bigint")).alias("exit_code"), F.count_if("changed").alias("changed"))


@query(lambda: " UNION ALL ".join(f"SELECT * FROM ({_cleaned_sql(p)}SELECT z.doc_id, d.lang, z.text, z.removed, z.folded, z.normalized, z.removed + z.folded + z.normalized AS transformed, z.text <> z.t AS changed, 'complete' AS parse_status FROM z JOIN documents d USING (doc_id) WHERE {w})" for p, w in (("prose", "d.lang = 'en'"), ("code", "d.lang = 'de'"), ("data", "d.lang NOT IN ('en', 'de') OR d.lang IS NULL"))))
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4-X10 on texts with addresses; the profile goes by language."""
    profile = F.when(F.col("lang") == "en", "prose").when(F.col("lang") == "de", "code").otherwise("data")
    return inspection.clean(_docs(spark, sf_dir, "lang"), profile)


@query(lambda: f"WITH src AS (SELECT doc_id, {dirty()} AS text FROM documents)" + O.regions("src") + " SELECT doc_id, CAST(place + len(head) AS BIGINT) AS start, CAST(place + len(head) + len(link) AS BIGINT) AS \"end\", 'literal' AS mode FROM piece WHERE link IS NOT NULL AND link <> ''")
def protected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4-X7."""
    d = inspection.spread(_docs(spark, sf_dir).where(~C.has_no_regions(F.col("text"))))
    r = d.select("doc_id", F.explode_outer(U.protected_regions("text")).alias("r")).where("r IS NOT NULL")
    return r.select("doc_id", _long("r.start").alias("start"), _long("r.end").alias("end"), "r.mode")


@query(lambda: O.characters() + O.WORDS + f", cf(k, v) AS ({O._values(sorted(T.lookalikes().items()))}), nf(k, v) AS ({O._values(C._compatibility())}), odd AS (SELECT doc_id, unnest(suspicious_offsets) AS pos FROM runs), o AS (SELECT f.doc_id, string_agg(coalesce(nf.v, CASE WHEN odd.pos IS NOT NULL THEN cf.v END, f.c), '' ORDER BY f.pos) AS text, count(nf.v) + count(CASE WHEN nf.v IS NULL AND odd.pos IS NOT NULL THEN cf.v END) AS changed FROM f LEFT JOIN nf ON nf.k = f.c LEFT JOIN cf ON cf.k = f.c LEFT JOIN odd ON odd.doc_id = f.doc_id AND odd.pos = f.pos GROUP BY 1) SELECT doc_id, text, changed FROM o")
def fold_confusables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4, over the texts with candidates."""
    d = _docs(spark, sf_dir).where(C.is_candidate(F.col("text")))
    return d.select("doc_id", U.fold_confusables("text").alias("r")).select("doc_id", "r.text", F.col("r.changed").cast("bigint").alias("changed"))


_SHOWN = "CASE WHEN unicode(c) < 32 OR unicode(c) BETWEEN 127 AND 159 THEN printf('\\x%02x', unicode(c)) WHEN unicode(c) IN (1564, 8206, 8207) OR unicode(c) BETWEEN 8234 AND 8238 OR unicode(c) BETWEEN 8294 AND 8297 THEN printf('\\u%04x', unicode(c)) ELSE c END"


@query(lambda: f"WITH s AS (SELECT doc_id, {dirty()} AS text FROM documents), ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM s), e AS (SELECT doc_id, string_agg({_SHOWN}, '' ORDER BY p) AS safe FROM ch WHERE c <> '' GROUP BY 1) SELECT s.doc_id, coalesce(e.safe, '') AS safe FROM s LEFT JOIN e USING (doc_id)")
def terminal_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6."""
    return _docs(spark, sf_dir).select("doc_id", U.terminal_safe("text").alias("safe"))


# --- files and containers -----------------------------------------------------------------

_PATHS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '/README.md' WHEN 1 THEN url || '/data.JSONL' WHEN 2 THEN url || '/.git/config' WHEN 3 THEN url || '/node_modules/a.js' WHEN 4 THEN url || '/.md' ELSE url || '/main.py' END AS path FROM pages"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PATHS.replace("FROM pages", "FROM {pages}"), pages=_table(spark, sf_dir, "pages"))


@query(lambda: f"SELECT page_id, path, CASE WHEN regexp_matches(lower(path), '[^/]\\.(md|markdown|txt|rst)$') THEN 'prose' WHEN regexp_matches(lower(path), '[^/]\\.(csv|tsv|json|jsonl)$') THEN 'data' ELSE 'code' END AS profile FROM ({_PATHS})")
def profile_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9."""
    return _paths(spark, sf_dir).withColumn("profile", C.infer_profile(F.col("path")))


@query(lambda: f"SELECT DISTINCT path FROM ({_PATHS}) WHERE NOT regexp_matches(path, '/(\\.git|node_modules)/')")
def expand_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped directories go, each path stays once."""
    return files.expand(_paths(spark, sf_dir).select("path"))


@query(lambda: "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'pdf' WHEN 3 THEN 'office' WHEN 4 THEN 'svg' WHEN 5 THEN 'svg' END AS fmt FROM pages")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By leading bytes, in the JVM."""
    heads = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"%PDF-1.7", b"PK\3\4", b"\n <svg>", b"<?xml version='1.0'?><svg>", b"<?xml?>", b"")
    arm = F.lit(heads[-1])
    for i in range(len(heads) - 1):
        arm = F.when(F.col("page_id") % 8 == i, F.lit(heads[i])).otherwise(arm)
    content = F.concat(arm, F.regexp_replace("html", "<", "(").cast("binary"))
    return _table(spark, sf_dir, "pages").select("page_id", C.detect_format(content).alias("fmt"))


@query(lambda: "SELECT page_id, 'png' AS fmt, 'complete' AS parse_status, CASE WHEN strlen(url) > 200 THEN url[:197] || '...' ELSE url END AS title, 'refused' AS clean_status FROM pages")
def png_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's url as the title of an image."""
    return _containers(spark, sf_dir, samples.png, "png.tEXt.Title")


@query(lambda: "SELECT page_id, 'jpeg' AS fmt, 'complete' AS parse_status, url[:200] AS title, 'refused' AS clean_status FROM pages")
def jpeg_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P5."""
    return _containers(spark, sf_dir, samples.jpeg, "jpeg.comment")


@query(lambda: "SELECT page_id, 'svg' AS fmt, 'complete' AS parse_status, url[:200] AS title, 'unsupported' AS clean_status FROM pages")
def svg_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, P10."""
    return _containers(spark, sf_dir, samples.svg, "svg.title")


@query(lambda: "SELECT page_id, 'office' AS fmt, 'complete' AS parse_status, url[:200] AS title, 'unsupported' AS clean_status FROM pages")
def office_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, P13."""
    return _containers(spark, sf_dir, samples.docx, "office.core.title")


@query(lambda: "SELECT page_id, 'pdf' AS fmt, 'partial' AS parse_status, url[:200] AS title, 'unsupported' AS clean_status FROM pages")
def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    return _containers(spark, sf_dir, samples.pdf, "pdf.info.Title")


def _containers(spark: SparkSession, sf_dir: str, build: Callable[[str], bytes], key: str) -> DataFrame:
    made = F.pandas_udf(lambda s: s.map(build), "binary")
    p = _table(spark, sf_dir, "pages").select("page_id", made("url").alias("content"))
    m = p.select("page_id", U.parse_metadata("content", F.lit(None).cast("string")).alias("m"), U.clean_container("content", F.lit(key.split(".")[0])).alias("c"))
    status = C.lifted(F.col("m.metadata"), F.col("m.fmt"))["parse_status"]
    return m.select("page_id", "m.fmt", status.alias("parse_status"), F.col("m.metadata")[key].alias("title"), F.col("c.parse_status").alias("clean_status"))


@query(lambda: "SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'malformed' ELSE 'complete' END AS parse_status, CAST(CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS metadata_keys, page_id % 4 = 1 AS has_warnings, false AS is_clean, CAST(CASE WHEN page_id % 4 = 1 THEN 2 ELSE 0 END AS BIGINT) AS exit_code FROM pages")
def report_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, warnings and substantive keys out of metadata maps."""
    k = F.col("page_id") % 4
    meta = F.when(k == 1, F.create_map(F.lit("png.parse_status"), F.lit("malformed"), F.lit("png.warning.structure"), F.lit("cut"), F.lit("png.tEXt.A"), F.col("url"), F.lit("png.exif"), F.lit("3 bytes")))
    meta = meta.otherwise(F.create_map(F.lit("png.parse_status"), F.lit("complete"), F.lit("png.coverage"), F.lit("chunks"), F.lit("png.tEXt.A"), F.col("url")))
    p = _table(spark, sf_dir, "pages").select("page_id", meta.alias("metadata"))
    lift = C.lifted(F.col("metadata"), F.lit("png"))
    p = p.select("page_id", "metadata", *[c.alias(n) for n, c in lift.items()])
    clean = C.is_clean(F.col("parse_status"), F.lit(0), F.col("metadata"), F.col("warnings"), F.col("refusal_reasons"))
    code = C.inspect_exit(F.col("parse_status"), F.lit(False), F.lit(False)).cast("bigint")
    return p.select("page_id", "parse_status", F.size(C.substantive(F.col("metadata"))).cast("bigint").alias("metadata_keys"), (F.size("warnings") > 0).alias("has_warnings"), clean.alias("is_clean"), code.alias("exit_code"))


_FILES = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'p/' || page_id || '.txt' WHEN 1 THEN 'p/' || page_id || '.svg' WHEN 2 THEN 'p/' || page_id || '.png' WHEN 3 THEN 'p/' || page_id || '.log' WHEN 4 THEN 'p/' || page_id || '.jpg' ELSE 'p/' || page_id || '.bin' END AS path FROM pages"""


@query(lambda: f"""WITH f AS ({_FILES})
SELECT path, CASE page_id % 6 WHEN 1 THEN 'svg' WHEN 2 THEN 'png' WHEN 4 THEN 'jpeg' ELSE 'text' END AS kind, CAST(CASE page_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 5 THEN 1 ELSE 0 END AS BIGINT) AS total,
  CASE page_id % 6 WHEN 3 THEN 'resource_limit' WHEN 4 THEN 'resource_limit' ELSE 'complete' END AS parse_status, CASE WHEN page_id % 6 = 2 THEN 'a title' END AS title, page_id % 6 IN (3, 4) AS warned,
  CASE page_id % 6 WHEN 1 THEN ['statistical text watermark', 'C2PA credential and hard-binding validity'] WHEN 2 THEN ['C2PA credential and hard-binding validity'] WHEN 4 THEN ['C2PA credential and hard-binding validity', 'container parsing completeness'] ELSE ['statistical text watermark'] END AS undeterminable FROM f""")
def file_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text, SVG and image files, some over a limit, some not UTF-8."""
    k = F.col("page_id") % 6
    html = F.regexp_replace("html", r"[^\t\n\r\x20-\x7e]", "?")
    drawn = F.concat(F.lit("<svg><title>a\u200b\u2014</title><desc>\u202e"), F.regexp_replace(html, "[<&>]", " "), F.lit("</desc></svg>"))
    content = F.when(k == 0, F.concat(F.lit("\ufeff"), html, F.lit("\u2014")).cast("binary")).when(k == 1, drawn.cast("binary")).when(k == 2, F.lit(samples.png("a title")))
    content = content.when(k == 4, F.lit(samples.jpeg())).when(k == 5, F.concat(F.lit(b"\xe2\x80\x8b\xff"), F.encode(html, "UTF-8"))).otherwise(F.encode(html, "UTF-8"))
    length = F.when(k == 3, 4_000_001).when(k == 4, 300 << 20).otherwise(F.length(content))
    named = spark.sql(_FILES.replace("FROM pages", "FROM {pages}"), pages=_table(spark, sf_dir, "pages"))
    f = _table(spark, sf_dir, "pages").join(named, "page_id").select("path", length.cast("bigint").alias("length"), content.alias("content"))
    r = files.inspect(f)
    return r.select("path", "kind", "total", "parse_status", F.try_element_at("metadata", F.lit("png.tEXt.Title")).alias("title"), (F.size("warnings") > 0).alias("warned"), "undeterminable")


# --- conformance ---------------------------------------------------------------------------


@query(lambda: f"WITH c(name, tier, grp, given, expect) AS ({O._values(audit.CASES)}) SELECT tier, grp, count(*) AS cases, count(*) AS passed, count(*) FILTER (WHERE given <> expect) AS removals FROM c GROUP BY 1, 2")
def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our cleaner on the conformance cases."""
    r = audit.run(audit.corpus(spark), {"quillsift": audit.own})
    return r.groupBy("tier", "grp").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.count_if("is_removal").alias("removals"))


@query(lambda: f"""WITH c(name, tier, grp, given, expect) AS ({O._values(audit.CASES)}),
o AS (SELECT tool, c.*, CASE tool WHEN 'ascii_only' THEN regexp_replace(given, '[^\\x00-\\x7f]', '', 'g') WHEN 'nothing' THEN given WHEN 'quillsift' THEN expect END AS produced FROM c, (VALUES ('ascii_only'), ('nothing'), ('quillsift'), ('raises')) t(tool)),
p AS (SELECT *, coalesce(regexp_replace(produced, '[\\r\\n]+$', '') = regexp_replace(expect, '[\\r\\n]+$', ''), false) AS ok FROM o)
SELECT tool, count(*) FILTER (WHERE ok AND tier = 'correctness') AS passed, count(*) FILTER (WHERE tier = 'correctness') AS scored, count(*) FILTER (WHERE NOT ok AND grp = 'load-bearing') AS corruptions, count(*) FILTER (WHERE NOT ok AND grp = 'contraband') AS leaks FROM p GROUP BY tool""")
def audit_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool that strips everything corrupts, one that does nothing leaks, one that raises fails case by case."""
    return audit.summary(audit.run(audit.corpus(spark), {"quillsift": audit.own, "ascii_only": audit.ascii_only, "nothing": audit.nothing, "raises": audit.raises}))


@query(lambda: O.characters() + "SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(removed) AS BIGINT) AS removed FROM stripped")
def streaming_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files, cleaned into an append-only dataset."""
    from quillsift.streaming import streams

    return streams.cleaned_totals(spark, f"{sf_dir}/documents.parquet", dirty())


# --- fixed cases ------------------------------------------------------------------------------

for _fn, _sql in pins.PINS.items():
    query(_sql)(_fn)
