"""Arrow-batched wrappers of the kernels, and their SQL registration.

Rows that the JVM-side prefilter clears never reach Python: their argument is
null and their result is filled in by the column expressions around the call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from inspect import signature

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import columns as C
from quillsift.functions import kernels as K
from quillsift.functions import taxonomy as T
from quillsift.sources import containers

FINDING = "struct<codepoint:int,category:string,severity:string,name:string,offset:int,line:int,column:int,context:string>"
RUN = "struct<text:string,offset:int,scripts:array<string>,span_start:int,span_end:int,suspicious_offsets:array<int>>"
REGION = "struct<start:int,end:int,mode:string>"
CLEANED = "struct<cleaned:string,removed:int,folded:int,normalized:int,changed:boolean,parse_status:string>"
INSPECTED = f"struct<findings:array<{FINDING}>,parse_status:string,warnings:array<string>>"
METADATA = "struct<fmt:string,metadata:map<string,string>>"
PART = "struct<kind:string,offset:bigint,body_start:bigint,body_end:bigint,end:bigint>"


class _Lazy:
    """A pandas UDF that is made at its first use, as types can only be parsed in a session."""

    def __init__(self, fn: Callable, schema: str) -> None:
        self.fn, self.schema = fn, schema
        self.made = None

    def udf(self):
        if self.made is None:
            self.made = F.pandas_udf(self.fn, self.schema)
        return self.made

    def __call__(self, *cols) -> Column:
        return self.udf()(*cols)


_FINDING = pa.struct([("codepoint", pa.int32()), ("category", pa.string()), ("severity", pa.string()), ("name", pa.string()), ("offset", pa.int32()), ("line", pa.int32()), ("column", pa.int32()), ("context", pa.string())])


def _finding_lists(rows: list[list[K.Finding] | None]) -> pa.Array:
    """Lists of findings column by column, without an object for each."""
    offs = [0]
    for r in rows:
        offs.append(offs[-1] + len(r or ()))
    flat = list(zip(*(f for r in rows for f in r or ()))) or [[]] * _FINDING.num_fields
    values = pa.StructArray.from_arrays([pa.array(x, _FINDING[i].type) for i, x in enumerate(flat)], fields=list(_FINDING))
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values, mask=pa.array([r is None for r in rows], pa.bool_()))


#: Bytes of text that are made into Python objects and results at a time, of a batch of any size.
SLICE = 1 << 20


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, end row): runs of rows of about SLICE bytes, one row at least; one empty run for no rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends) or not start:
        done = int(ends[start - 1]) if start else 0
        end = min(len(ends), max(start + 1, int(np.searchsorted(ends, done + SLICE, side="right"))))
        yield start, end
        if end == len(ends):
            return
        start = end


class _Native(_Lazy):
    """The same over Arrow arrays, of which the first is the text; results leave slice by slice, so that neither they nor their objects grow with a batch."""

    def udf(self):
        if self.made is None:
            fn = self.fn

            # The two forms differ in how Spark passes arguments.
            def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for text in batches:
                    for lo, hi in _slices(text):
                        yield fn(text.slice(lo, hi - lo))

            def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                for args in batches:
                    for lo, hi in _slices(args[0]):
                        yield fn(*(x.slice(lo, hi - lo) for x in args))

            single = len(signature(fn).parameters) == 1
            self.made = F.arrow_udf(one if single else more, self.schema)
        return self.made


def _arrow(schema: str) -> Callable[[Callable], _Lazy]:
    return lambda fn: _Lazy(fn, schema)


def _native(schema: str) -> Callable[[Callable], _Native]:
    return lambda fn: _Native(fn, schema)


def _structs(items) -> list[dict]:
    return [x._asdict() for x in items]


def _per_text(text: pa.Array, fn: Callable, kind: pa.DataType) -> pa.Array:
    return pa.array([None if t is None else fn(t) for t in text.to_pylist()], kind)


def _columns(rows: list[tuple], names: Sequence[str], *kinds: pa.DataType) -> pa.StructArray:
    values = list(zip(*rows)) or [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(values, kinds)], names=list(names))


def _each(s: pd.Series, fn: Callable) -> pd.Series:
    return pd.Series([None if x is None else fn(x) for x in s], dtype=object)


def _inspect_arrow(text: pa.Array, width: pa.Array) -> pa.Array:
    rows = [K.Inspection([], None, []) if t is None else K.inspect(t, w) for t, w in zip(text.to_pylist(), width.to_pylist())]
    return pa.StructArray.from_arrays([_finding_lists([r.findings for r in rows]), pa.array([r.parse_status for r in rows], pa.string()), pa.array([r.warnings for r in rows], pa.list_(pa.string()))], names=["findings", "parse_status", "warnings"])


_inspect = _Native(_inspect_arrow, INSPECTED)
_inspect_once = _Native(_inspect_arrow, INSPECTED)


@_native(CLEANED)
def _clean(text: pa.Array, profile: pa.Array) -> pa.Array:
    rows = [(None,) * 6 if t is None else K.clean(t, p) for t, p in zip(text.to_pylist(), profile.to_pylist())]
    return _columns(rows, K.Cleaned._fields, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())


codepoint_findings = _Native(lambda text: _finding_lists([None if t is None else list(K.findings(t)) for t in text.to_pylist()]), f"array<{FINDING}>")
all_findings = _Native(lambda text, width: _finding_lists([None if t is None else K.all_findings(t, w) for t, w in zip(text.to_pylist(), width.to_pylist())]), f"array<{FINDING}>")


_RUN = pa.struct([("text", pa.string()), ("offset", pa.int32()), ("scripts", pa.list_(pa.string())), ("span_start", pa.int32()), ("span_end", pa.int32()), ("suspicious_offsets", pa.list_(pa.int32()))])
_REGION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("mode", pa.string())])


@_native(f"array<{RUN}>")
def suspicious_runs(text: pa.Array) -> pa.Array:
    return _per_text(text, lambda t: [{**r._asdict(), "scripts": list(r.scripts), "suspicious_offsets": list(r.suspicious_offsets)} for r in K.suspicious_runs(t)], pa.list_(_RUN))


@_native(f"array<{REGION}>")
def protected_regions(text: pa.Array) -> pa.Array:
    return _per_text(text, lambda t: _structs(K.protected_regions(t)), pa.list_(_REGION))


@_native("array<int>")
def load_bearing(text: pa.Array) -> pa.Array:
    return _per_text(text, lambda t: sorted(K.load_bearing(t)), pa.list_(pa.int32()))


@_native("struct<text:string,removed:int>")
def strip_invisible(text: pa.Array) -> pa.Array:
    return _columns([(None, None) if t is None else K.strip_invisible(t) for t in text.to_pylist()], ("text", "removed"), pa.string(), pa.int32())


@_native("struct<text:string,changed:int>")
def fold_confusables(text: pa.Array) -> pa.Array:
    return _columns([(None, None) if t is None else K.fold_confusables(t) for t in text.to_pylist()], ("text", "changed"), pa.string(), pa.int32())


@_native("string")
def terminal_safe(text: pa.Array) -> pa.Array:
    return _per_text(text, K.terminal_safe, pa.string())


@_native("array<string>")
def scripts_in(text: pa.Array) -> pa.Array:
    return _per_text(text, lambda t: sorted(T.scripts_in(t)), pa.list_(pa.string()))


@_arrow(METADATA)
def parse_metadata(content: pd.Series, path: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if b is None else containers.parse_bytes(bytes(b), p) for b, p in zip(content, path)]
    return pd.DataFrame({"fmt": [r[0] for r in rows], "metadata": pd.Series([r[1] for r in rows], dtype=object)})


@_arrow(f"struct<parts:array<{PART}>,status:string,reason:string>")
def scan_structure(content: pd.Series) -> pd.DataFrame:
    scans = []
    for b in content:
        raw = bytes(b) if b is not None else b""
        fmt = containers.detect_format(raw)
        scans.append({"png": containers.scan_png, "jpeg": containers.scan_jpeg}.get(fmt, lambda _: containers.Scan([], "unsupported", "no chunk structure"))(raw))
    return pd.DataFrame({"parts": [_structs(s.parts) for s in scans], "status": [s.status for s in scans], "reason": [s.reason for s in scans]})


@_arrow("struct<metadata:map<string,string>,parse_status:string>")
def clean_container(content: pd.Series, fmt: pd.Series) -> pd.DataFrame:
    rows = [({}, None) if b is None else containers.clean_bytes(bytes(b), f or "")[1:] for b, f in zip(content, fmt)]
    return pd.DataFrame({"metadata": pd.Series([r[0] for r in rows], dtype=object), "parse_status": [r[1] for r in rows]})


@_arrow("boolean")
def is_valid_zip(content: pd.Series) -> pd.Series:
    return _each(content, lambda b: containers.is_valid_zip(bytes(b)))


@_arrow("string")
def svg_text(content: pd.Series) -> pd.Series:
    return _each(content, lambda b: containers.svg_text(bytes(b)))


# --- prefiltered columns --------------------------------------------------------


def inspected(text: Column, width: int = 24) -> Column:
    """findings, parse_status and warnings; only texts with candidates, or over the limit, go to Python."""
    needed = C.is_candidate(text) | (F.length(text) > T.MAX_TEXT)
    # A filter on a report would run the function in a second set of workers if it counted as deterministic.
    got = _inspect_once.udf().asNondeterministic()(F.when(needed, text), F.lit(width))
    calm = F.struct(F.array().cast(f"array<{FINDING}>").alias("findings"), F.lit("complete").alias("parse_status"), F.array().cast("array<string>").alias("warnings"))
    return F.when(text.isNull(), None).when(needed, got).otherwise(calm)


def cleaned(text: Column, profile: Column) -> Column:
    """Clean texts pass by: they have neither candidates nor CRLF."""
    needed = C.is_candidate(text) | F.contains(text, F.lit("\r\n")) | (F.length(text) > T.MAX_TEXT)
    got = _clean(F.when(needed, text), profile)
    zero = F.lit(0)
    same = F.struct(text.alias("cleaned"), zero.alias("removed"), zero.alias("folded"), zero.alias("normalized"), F.lit(False).alias("changed"), F.lit("complete").alias("parse_status"))
    return F.when(text.isNull(), None).when(needed, got).otherwise(same)


# --- SQL ------------------------------------------------------------------------


def _table_function(schema: str, rows: Callable):
    from pyspark.sql.functions import udtf

    class Rows:
        def eval(self, value):
            if value is not None:
                yield from rows(value)

    return udtf(Rows, returnType=schema)


def register(spark: SparkSession) -> None:
    """Kernels as SQL functions, and generators as table functions for LATERAL calls."""
    for name, fn in (
        ("qs_clean_text", _clean), ("qs_inspect_text", _inspect), ("qs_strip_invisible", strip_invisible), ("qs_fold_confusables", fold_confusables),
        ("qs_terminal_safe", terminal_safe), ("qs_load_bearing", load_bearing), ("qs_scripts_in", scripts_in), ("qs_parse_metadata", parse_metadata), ("qs_clean_container", clean_container),
    ):
        spark.udf.register(name, fn.udf())
    strip = lambda s: s.removeprefix("struct<").removesuffix(">")
    fields = lambda s: ", ".join(f"`{n}` {t}" for n, t in (x.split(":", 1) for x in strip(s).split(",")))
    tables = {
        "qs_findings": (FINDING, K.findings),
        "qs_suspicious_runs": (RUN, lambda t: ((r.text, r.offset, list(r.scripts), r.span_start, r.span_end, list(r.suspicious_offsets)) for r in K.suspicious_runs(t))),
        "qs_protected_regions": (REGION, K.protected_regions),
        "qs_png_chunks": (PART, lambda b: containers.scan_png(bytes(b)).parts),
        "qs_jpeg_segments": (PART, lambda b: containers.scan_jpeg(bytes(b)).parts),
    }
    for name, (schema, rows) in tables.items():
        spark.udtf.register(name, _table_function(fields(schema), rows))
