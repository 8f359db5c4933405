"""WARC archives: from one gzip stream over a whole file to one member per record.

A monolithic archive compresses all its records as one stream, so no record can
be read without all before it. normalise() inflates each file once, piece by
piece, writes every record as a gzip member of its own into a new file and a
sidecar index of (record, offset, length, type, uri, payload size, digest).
With the index a reader fetches one record by one ranged read. Memory does not
grow with the file: index rows go to the sidecar as they arise; one header, of any
length, and one compressed record are held until the record proves whole.

Files live in a folder that all executors share, reached through its URI. Each
task writes under a name of its own attempt and renames when complete, so
retried and speculative tasks leave whole files only. A result has its input's name;
inputs of one name from several folders get a digest of their path before it.

Pages are written as ``resource`` records, as they come without HTTP headers.

Defined results: null urls and html are marked and come back as nulls; empty
html is a record without payload; repeated pages are records of their own;
control characters and spaces of a page's url are percent-encoded in the header, which
says so, and come back; URIs of other archives stay as they are; a truncated or malformed
file gives its whole records and one row
with its status; an empty file gives a row with status ``empty``; other columns
are not looked at. page_id must be an integer.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import cut, discard, id64, scratch

PIECE = 1 << 18
INDEX = "source string, file string, record bigint, offset bigint, length bigint, warc_type string, uri string, page_id bigint, payload_bytes bigint, payload_md5 string, status string"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if c != 0x25)


def record_bytes(page_id: int | None, url: str | None, html: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC resource record; the same page always gives the same bytes. Pages have no date of their own."""
    body = (html or "").encode("utf-8", "surrogatepass")
    name = uuid.UUID(bytes=hashlib.md5(repr((page_id, url)).encode() + body).digest())
    nulls = ",".join(k for k, v in (("page_id", page_id), ("url", url), ("html", html)) if v is None)
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}", "Page-URI-Encoding: percent", "Content-Type: text/html; charset=utf-8", f"Page-ID: {page_id if page_id is not None else ''}"]
    lines += [f"Page-Nulls: {nulls}"] * bool(nulls) + [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


class _Out:
    """A file under an attempt's own name, renamed when it is whole."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        self.temp = f"{self.path}.{task.taskAttemptId() if task else 0}.{uuid.uuid4().hex[:8]}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.temp, compression=None)

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temp, self.path)


def write_monolithic(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Each partition as one archive that is one gzip stream; gives the paths. To be computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pack = None, zlib.compressobj(level, zlib.DEFLATED, 31)
        part = TaskContext.get().partitionId()
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3))):
                out = out or _Out(f"{folder}/part-{part:06d}.warc.gz")
                out.stream.write(pack.compress(record_bytes(*row)))
        if out:
            out.stream.write(pack.flush())
            out.commit()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{part:06d}.warc.gz"])], names=["path"])

    return cut(pages.select(id64(pages, "page_id"), "url", "html").mapInArrow(run, "path string"))


class Inflated:
    """The content of a gzip file of one or more members, read in bounded pieces."""

    def __init__(self, stream) -> None:
        self.stream, self.unpack, self.held, self.whole = stream, zlib.decompressobj(31), bytearray(), True
        self.more = True

    def fill(self) -> bool:
        """Adds a piece; False at the end."""
        while self.more:
            raw = self.unpack.unconsumed_tail
            if self.unpack.eof:
                raw = self.unpack.unused_data or self.stream.read(PIECE)
                if not raw:
                    self.more = False
                    return False
                self.unpack = zlib.decompressobj(31)
            elif not raw:
                raw = self.stream.read(PIECE)
                if not raw:
                    self.more, self.whole = False, False
                    return False
            try:
                got = self.unpack.decompress(raw, PIECE)
            except zlib.error:
                self.more, self.whole = False, False
                return False
            if got:
                self.held += got
                return True
        return False

    def header(self) -> bytes | None:
        """Up to the blank line, however far; None where there is no whole header.

        What doesn't begin like a record is given back once a piece is held, not read to the end.
        """
        at = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(self.held)
            if at > PIECE and not self.held.startswith(b"WARC/"):
                return bytes(self.held)
            if not self.fill():
                return None
        out = bytes(self.held[: end + 4])
        del self.held[: end + 4]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.fill():
                return
            got = bytes(self.held[:n])
            del self.held[: len(got)]
            n -= len(got)
            yield got

    def at_end(self) -> bool:
        while not self.held:
            if not self.fill():
                return True
        return False


def _fields(header: bytes) -> dict[str, str] | None:
    lines = header.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}


def normalise_file(source: str, target: str, level: int = 6) -> Iterator[tuple]:
    """The index rows of one file, one by one; writes the target and its sidecar, which are there once all rows were taken."""
    fs, path = pafs.FileSystem.from_uri(source)
    out, side = _Out(target), _Out(target + ".index.jsonl")
    name, offset, status, n = target.rsplit("/", 1)[-1], 0, "complete", 0

    def noted(*row) -> tuple:
        row = (source, name, n, *row)
        side.stream.write((json.dumps(dict(zip(_NAMES, row)), ensure_ascii=True) + "\n").encode())
        return row

    with fs.open_input_stream(path, compression=None) as stream:
        src = Inflated(stream)
        while not src.at_end():
            header = src.header()
            fields = _fields(header) if header else None
            size = fields.get("content-length", "") if fields else ""
            if not size.isdigit():
                status = "malformed" if src.whole and header else "truncated"
                break
            pack, start, digest, got = zlib.compressobj(level, zlib.DEFLATED, 31), offset, hashlib.md5(), 0
            member = [pack.compress(header)]
            for piece in src.pieces(int(size)):
                digest.update(piece)
                got += len(piece)
                member.append(pack.compress(piece))
            tail = b"".join(src.pieces(4))
            if got < int(size) or tail != b"\r\n\r\n":
                status = "truncated" if not src.whole else "malformed"
                break
            member += [pack.compress(tail), pack.flush()]
            for x in member:
                out.stream.write(x)
                offset += len(x)
            nulls = fields.get("page-nulls", "").split(",")
            page, uri = fields.get("page-id", ""), fields.get("warc-target-uri", "")
            uri = unquote(uri) if fields.get("page-uri-encoding") == "percent" else uri
            yield noted(start, offset - start, fields.get("warc-type"), None if "url" in nulls else uri, int(page) if page.lstrip("-").isdigit() else None, None if "html" in nulls else got, None if "html" in nulls else digest.hexdigest(), "complete")
            n += 1
        if status == "complete" and not src.whole:
            status = "truncated"
    if status == "complete" and not n:
        status = "empty"
    if status != "complete":
        yield noted(*[None] * 7, status)
    out.commit()
    side.commit()


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """The index of all files; one task per file, as one stream can't be split. Computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)
        for b in batches:
            for path, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held: list[tuple] = []
                for row in normalise_file(path, f"{folder}/{name}"):
                    held.append(row)
                    if len(held) == 5000:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    paths = paths.select("path").distinct().withColumn("base", F.regexp_extract("path", "[^/]+$", 0))
    alike = F.count(F.lit(1)).over(Window.partitionBy("base")) > 1
    paths = cut(paths.select("path", F.when(alike, F.concat(F.left(F.md5("path"), F.lit(12)), F.lit("-"), "base")).otherwise(F.col("base")).alias("name")))
    n = max(1, paths.count())
    return cut(paths.repartitionByRange(n, "path").mapInArrow(run, INDEX))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, html) of the indexed records, each by one ranged read and one member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name = stream = None
        for b in batches:
            out = []
            for file, offset, length, uri, page, size in zip(*(b.column(i).to_pylist() for i in range(6))):
                if file != name:
                    name, stream = file, fs.open_input_file(f"{base}/{file}")
                stream.seek(offset)
                record = zlib.decompress(stream.read(length), 31)
                at = record.index(b"\r\n\r\n") + 4
                out.append((page, uri, None if size is None else record[at : at + size].decode("utf-8", "replace")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "html"])

    rows = index.where("status = 'complete' AND offset IS NOT NULL").select("file", "offset", "length", "uri", "page_id", "payload_bytes")
    return rows.mapInArrow(run, "page_id bigint, url string, html string")


def _archived(pages: DataFrame) -> tuple[DataFrame, str]:
    """Pages as monolithic archives, normalised; the archives themselves are dropped again."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    index = normalise(write_monolithic(pages, f"{folder}/monolithic"), f"{folder}/records")
    discard(spark, f"{folder}/monolithic")
    return index, f"{folder}/records"


def archive_index(pages: DataFrame) -> DataFrame:
    """The index over all pages. Where their archives lay differs from run to run and is left out."""
    return _archived(pages)[0].drop("source")


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page back from its own member: page_id, url, and size and MD5 of its html."""
    index, folder = _archived(pages)
    return read_records(index, folder).select("page_id", "url", F.md5("html").alias("html_md5"), F.octet_length("html").cast("bigint").alias("html_bytes"))


ROUND_TRIP_ORACLE = "SELECT page_id, url, md5(html) AS html_md5, CAST(strlen(html) AS BIGINT) AS html_bytes FROM pages"
