"""Operators on DataFrames: nulls, limits, SQL functions, files, plans, and the package without its optional part."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillsift.functions import columns as C
from quillsift.functions import kernels as K
from quillsift.functions import udfs as U
from quillsift.operators import audit, inspection
from quillsift.plans import samples
from quillsift.sources import files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TEXTS = [None, "", "plain", "a​b", "“q”…  ", "x\r\ny", "pаy", "﻿`—` www.a.org/—"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


@pytest.mark.parametrize("profile", K.PROFILES)
def test_clean_is_the_kernel(docs, profile):
    for r in inspection.clean(docs, profile).collect():
        given = TEXTS[r.id]
        if given is None:
            assert r.text is None and r.changed is None
        else:
            c = K.clean(given, profile)
            assert (r.text, r.removed, r.folded, r.normalized, r.changed, r.transformed) == (*c[:5], c.removed + c.folded + c.normalized)


def test_reports_and_json(docs):
    got = {r.id: r for r in inspection.reports(docs).collect()}
    for i, t in enumerate(TEXTS):
        if t is not None:
            k = K.inspect(t)
            assert [f.offset for f in got[i].findings] == [f.offset for f in k.findings] and got[i].total == len(k.findings) and got[i].parse_status == "complete"
    for r in inspection.report_json(docs, "id").where("json IS NOT NULL").collect():
        assert r.json.isascii()
        body = json.loads(r.json)
        assert body["verifiable"]["total"] == got[r.id].total and body["not_determinable"]


def test_native_columns(spark, docs):
    r = {x.id: x for x in docs.where("text IS NOT NULL").select("id", C.fold_typography(F.col("text")).alias("t"), C.strip_controls(F.col("text")).alias("s"), C.count_category(F.col("text"), "smart_quote").alias("q"), C.line_of(F.col("text"), F.lit(3)).alias("line"), C.column_of(F.col("text"), F.lit(3)).alias("col")).collect()}
    assert r[4].t == '"q"...  ' and r[4].q == 2 and (r[5].line, r[5].col) == (2, 1)


def test_prefilter_is_below_python(docs):
    plan = inspection.findings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "RLIKE" in plan[plan.index("ArrowEvalPython") :]


def test_findings_have_no_limit(spark):
    many = spark.createDataFrame([(1, "x\u200b" * 10_050), (2, "y" * 1_100_000 + "\u200b")], "id int, text string")
    got = {r.id: r.n for r in inspection.findings(many).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 10_050, 2: 1}
    assert {r.id: (r.total, r.parse_status) for r in inspection.reports(many).collect()} == {1: (10_000, "resource_limit"), 2: (0, "resource_limit")}


def test_sql_functions(spark, docs):
    U.register(spark)
    docs.createOrReplaceTempView("d")
    assert spark.sql("SELECT qs_clean_text(text, 'code').cleaned AS c FROM d WHERE id = 4").first().c == '"q"...  '
    assert [r.offset for r in spark.sql("SELECT f.offset FROM d, LATERAL qs_findings(text) f WHERE id = 3").collect()] == [1]
    assert spark.sql("SELECT r.scripts FROM d, LATERAL qs_suspicious_runs(text) r").first().scripts == ["Cyrillic", "Latin"]
    assert spark.sql("SELECT count(*) n FROM d, LATERAL qs_protected_regions(text) r WHERE id = 7").first().n == 2
    spark.createDataFrame([(samples.png("t"), samples.jpeg("c"))], "p binary, j binary").createOrReplaceTempView("b")
    assert [r.kind for r in spark.sql("SELECT c.kind FROM b, LATERAL qs_png_chunks(p) c").collect()] == ["IHDR", "tEXt", "IDAT", "IEND"]
    assert spark.sql("SELECT count(*) n FROM b, LATERAL qs_jpeg_segments(j) c").first().n == 3
    assert spark.sql("SELECT qs_parse_metadata(p, NULL).metadata['png.tEXt.Title'] AS t FROM b").first().t == "t"


def test_files(spark, tmp_path):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / ".git" / "x.txt").write_text("​")
    (tmp_path / "in" / "a.md").write_bytes("a​—\r\n".encode())
    (tmp_path / "in" / "b.json").write_bytes("﻿[“]\r\n".encode())
    found = files.scan(spark, f"{tmp_path}/in")
    assert found.count() == 2 and files.check_budget(found) == [] and len(files.check_budget(found, 1, 1)) == 2
    out = {r.path.rsplit("/", 1)[-1]: r for r in files.clean_to(found, f"{tmp_path}/out").collect()}
    assert out["a.md"].text == "a—\r\n" and out["b.json"].text == '["]\n'
    (tmp_path / "in" / "p.png").write_bytes(samples.png("t"))
    (tmp_path / "in" / "s.svg").write_bytes(samples.svg("t"))
    with pytest.raises(ValueError, match="p.png"):
        files.clean_to(files.scan(spark, f"{tmp_path}/in"), f"{tmp_path}/out2")
    assert not (tmp_path / "out2").exists()
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.inspect(files.scan(spark, f"{tmp_path}/in")).collect()}
    assert got["p.png"].metadata == {"png.tEXt.Title": "t"} and got["s.svg"].kind == "svg" and got["a.md"].total == 2
    assert got["p.png"].undeterminable == ["C2PA credential and hard-binding validity"] and got["a.md"].undeterminable == ["statistical text watermark"]
    for name, body in (("big.txt", b"x" * 4_000_001), ("wide.svg", "<?xml version='1.0' encoding='utf-16'?><svg><title>a\u200b\u2014</title></svg>".encode("utf-16")), ("bad.bin", b"\xff\xfea\0")):
        (tmp_path / "in" / name).write_bytes(body)
    tree = files.scan(spark, f"{tmp_path}/in")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.inspect(tree).collect()}
    assert len(got) == tree.count() == 7
    assert (got["big.txt"].kind, got["big.txt"].parse_status, got["big.txt"].total) == ("text", "resource_limit", 0) and got["big.txt"].warnings
    assert (got["wide.svg"].kind, got["wide.svg"].total) == ("svg", 2) and got["bad.bin"].kind == "text"
    huge = files.inspect(tree.withColumn("length", F.lit(300 << 20))).collect()
    assert len(huge) == 7 and {r.parse_status for r in huge} == {"resource_limit"}
    (tmp_path / "in" / "p.png").unlink()
    with pytest.raises(ValueError, match="big.txt .over the text limit"):
        files.clean_to(files.scan(spark, f"{tmp_path}/in").where("path NOT LIKE '%svg'"), f"{tmp_path}/out3")


def test_audit(spark):
    r = audit.run(audit.corpus(spark), {"own": audit.own, "raises": audit.raises})
    s = {x.tool: x for x in audit.summary(r).collect()}
    assert (s["own"].passed, s["own"].scored, s["own"].corruptions, s["own"].leaks) == (40, 40, 0, 0) and s["raises"].passed == 0
    assert r.where("tool = 'own' AND NOT passed").count() == 0 and len(audit.CASES) == 54
    text = audit.markdown(r)
    assert "| own | 40 | 40 | 0 | 0 |" in text and "### load-bearing" in text and "## Policy cases" in text and "| own | 12 | 12 |" in text and "RuntimeError: no" in text
    assert set(audit.GROUPS) == {c[2] for c in audit.CASES}
    body = json.loads(audit.result_json(r))
    assert audit.result_json(r).isascii() and body["own"]["passed"] == 40 and len(body["raises"]["cases"]) == 54 and sum(g["cases"] for g in body["own"]["groups"]) == 54
    assert audit.shown("a​|\n") == "`aU+200B\\|\\n`"


def test_windowed_stream(spark, tmp_path):
    from quillsift.streaming import streams

    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'a' || '​' AS text UNION ALL SELECT timestamp'2024-01-01 00:07:00', '—'").write.parquet(f"{tmp_path}/d")
    d = streams.read_documents(spark, f"{tmp_path}/d", spark.read.parquet(f"{tmp_path}/d").schema)
    q = streams.findings_per_window(d).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.category, r.n) for r in spark.table("windows").collect()} == {("zero_width", 1), ("dash", 1)}


def test_entry_without_the_optional_package(tmp_path):
    """The other queries import and are listed when the optional folders are gone."""
    code = "import sys; sys.modules['quillsift.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(x.startswith('op') for x in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def sliced(udf, monkeypatch, *more):
    """Arrays that the function gives for one batch of texts beyond a slice, and what it gives for the batch as a whole."""
    import pyarrow as pa

    monkeypatch.setattr(U, "SLICE", 100)
    text = pa.array(["aе​b `x​y` http://a.b \x07 — " * 3, None, "", "plain"] * 20)
    args = [text, *(pa.array([x] * len(text)) for x in more)]
    got = list(udf.udf().func(iter([tuple(args) if more else text])))
    assert list(udf.udf().func(iter([tuple(x[:0] for x in args) if more else text[:0]])))[0].to_pylist() == []
    return got, udf.fn(*args)


def assert_sliced(udf, monkeypatch, *more):
    got, whole = sliced(udf, monkeypatch, *more)
    assert len(got) >= 20 and max(map(len, got)) <= 4
    assert [x for part in got for x in part.to_pylist()] == whole.to_pylist()


def test_findings_leave_a_batch_slice_by_slice(spark, monkeypatch):
    for udf, more in ((U.all_findings, (24,)), (U.codepoint_findings, ()), (U._inspect, (24,))):
        assert_sliced(udf, monkeypatch, *more)


def test_cleaned_texts_leave_a_batch_slice_by_slice(spark, monkeypatch):
    for profile in ("prose", "code", "data"):
        assert_sliced(U._clean, monkeypatch, profile)


def test_terminal_texts_leave_a_batch_slice_by_slice(spark, monkeypatch):
    assert_sliced(U.terminal_safe, monkeypatch)


def test_a_filter_on_reports_runs_the_inspection_once(spark):
    d = spark.createDataFrame([(1, "a​b"), (2, "plain"), (3, None)], "doc_id int, text string")
    r = inspection.reports(d).where("total > 0")
    assert r._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [x.doc_id for x in r.collect()] == [1]


def test_stripped_texts_leave_a_batch_slice_by_slice(spark, monkeypatch):
    assert_sliced(U.strip_invisible, monkeypatch)


def test_regions_runs_and_folds_leave_a_batch_slice_by_slice(spark, monkeypatch):
    for udf in (U.protected_regions, U.suspicious_runs, U.load_bearing, U.fold_confusables, U.scripts_in):
        assert_sliced(udf, monkeypatch)
    assert_sliced(inspection._json, monkeypatch, "source")
