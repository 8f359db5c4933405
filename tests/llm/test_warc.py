import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from quillsift.llm import warc as W

PAGES = "page_id bigint, url string, html string"
ROWS = [(1, "http://a/b?c=d e%20\r\nX: y", "<p>é</p>"), (1, "http://a/b", "<p>é</p>"), (None, None, None), (2, "", ""), (3, "http://ü", "x\r\n\r\nWARC/1.0\r\n" * 3), (4, "u", "long " * 200_000)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], PAGES + ", file string")
    folder = f"file://{tmp_path}"
    index = W.normalise(W.write_monolithic(pages.repartition(2), folder + "/in"), folder + "/out")
    back = sorted(map(tuple, W.read_records(index, folder + "/out").collect()), key=repr)
    assert back == sorted(ROWS, key=repr)
    for f in (tmp_path / "in").iterdir():
        one = zlib.decompressobj(31)
        one.decompress(f.read_bytes())
        assert one.eof and not one.unused_data  # a single stream
        assert gzip.decompress(f.read_bytes()) == gzip.decompress((tmp_path / "out" / f.name).read_bytes())
        assert (tmp_path / "out" / (f.name + ".index.jsonl")).read_text().count("\n") == index.where(F.col("file") == f.name).count()
    assert not list(tmp_path.rglob("*.part"))
    for r in index.collect():
        raw = (tmp_path / "out" / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert gzip.decompress(raw).startswith(b"WARC/1.0\r\n") and gzip.decompress(raw).endswith(b"\r\n\r\n")


def archive(tmp_path, raw, name="a.warc.gz"):
    (tmp_path / name).write_bytes(raw)
    return [(r[2], r[-1]) for r in W.normalise_file(f"file://{tmp_path}/{name}", f"file://{tmp_path}/out/{name}")]


def test_broken_files(tmp_path):
    one, two = W.record_bytes(1, "u", "a" * 50), W.record_bytes(2, "v", "".join(map(chr, range(33, 5000))))
    whole = gzip.compress(one + two)
    assert archive(tmp_path, whole) == [(0, "complete"), (1, "complete")]
    assert archive(tmp_path, gzip.compress(one) + gzip.compress(two)) == [(0, "complete"), (1, "complete")]
    assert archive(tmp_path, whole[: len(whole) // 2]) == [(0, "complete"), (1, "truncated")]
    assert archive(tmp_path, gzip.compress(one + b"junk\r\n\r\n")) == [(0, "complete"), (1, "malformed")]
    assert archive(tmp_path, gzip.compress(one[:-2])) == [(0, "malformed")]
    assert archive(tmp_path, gzip.compress(b"")) == [(0, "empty")]
    assert archive(tmp_path, b"no gzip at all")[0][1] == "truncated"
    assert gzip.decompress((tmp_path / "out" / "a.warc.gz").read_bytes() or gzip.compress(b"")) == b""


def test_a_url_of_megabytes_hides_no_record(spark, tmp_path):
    rows = [(1, "data:text/plain," + "a" * 1_300_000, "x"), (2, "http://ü/" + "é" * 400_000, "y"), (3, "http://c", "z")]
    folder = f"file://{tmp_path}"
    index = W.normalise(W.write_monolithic(spark.createDataFrame(rows, PAGES).coalesce(1), folder + "/in"), folder + "/out")
    assert [r.status for r in index.collect()] == ["complete"] * 3
    assert sorted(map(tuple, W.read_records(index, folder + "/out").collect())) == rows
    assert archive(tmp_path, gzip.compress(W.record_bytes(1, "u", "a") + b"junk" * 500_000)) == [(0, "complete"), (1, "malformed")]


def foreign(uri, body, *more, kind="response", end="\r\n"):
    """A record as other writers make it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}", "WARC-Date: 2020-02-02T02:02:02Z", "WARC-Record-ID: <urn:uuid:1>", *more, f"content-length:{len(body)}", "", ""]
    return end.join(lines).encode() + body + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    for n in ("x", "y"):
        (tmp_path / n).mkdir()
        raw = foreign("http://h/a%20b%2Fc", b"HTTP/1.1 200 OK\r\n\r\n" + n.encode()) + foreign("", b"software: s", kind="warcinfo") + foreign("http://h/" + n, b"", "X-Long: " + "v" * (2 << 20), kind="metadata")
        (tmp_path / n / "a.warc.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "x" / "b.warc.gz").write_bytes(gzip.compress(foreign("u", b"1")))
    folder = f"file://{tmp_path}"
    paths = spark.createDataFrame([(f"{folder}/{p}",) for p in ("x/a.warc.gz", "y/a.warc.gz", "x/b.warc.gz", "x/b.warc.gz")], "path string")
    rows = W.normalise(paths, folder + "/out").collect()
    assert len(rows) == 7 and {r.status for r in rows} == {"complete"} and len({r.file for r in rows}) == 3 and "b.warc.gz" in {r.file for r in rows}
    for r in rows:
        raw = (tmp_path / "out" / r.file).read_bytes()
        record = gzip.decompress(raw[r.offset : r.offset + r.length])
        whole = gzip.decompress((tmp_path / r.source.removeprefix(folder + "/")).read_bytes())
        assert record in whole and gzip.decompress(raw) == whole
        assert (r.uri, r.warc_type) in {("http://h/a%20b%2Fc", "response"), ("", "warcinfo"), ("http://h/x", "metadata"), ("http://h/y", "metadata"), ("u", "response")}


def test_records_have_what_the_format_asks_for():
    head = W.record_bytes(1, "http://a", "x").split(b"\r\n\r\n")[0].decode().split("\r\n")
    assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= {x.split(":")[0] for x in head} and "WARC-Type: resource" in head


@pytest.mark.parametrize("n", [0])
def test_no_pages(spark, n):
    empty = spark.createDataFrame([], PAGES)
    assert W.archive_index(empty).count() == n and W.round_trip(empty).count() == n
