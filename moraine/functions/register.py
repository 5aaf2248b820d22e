"""SQL functions and table functions over paths and bytes."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import functions as L
from ..operators import codecs as C
from ..operators.chunking import cuts

_SQL = {
    "group_key": ("path STRING", "STRING", "CASE WHEN instr(path, '.') > 0 AND octet_length(lower(substring_index(path, '.', -1))) BETWEEN 1 AND 16 AND instr(substring_index(path, '.', -1), '/') = 0 THEN lower(substring_index(path, '.', -1)) ELSE '' END"),
    "selector_matches": ("path STRING, sel STRING", "BOOLEAN", "path = rtrim('/', replace(sel, '\\\\', '/')) OR startswith(path, concat(rtrim('/', replace(sel, '\\\\', '/')), '/'))"),
    "stored_bytes": ("packed BIGINT, unpacked BIGINT, len BIGINT", "BIGINT", "CASE WHEN unpacked = 0 OR len >= unpacked THEN packed ELSE (packed * len) div unpacked END"),
}
_DEVICES = ", ".join(f"'{x}'" for x in L.DEVICES)
_SQL["path_ok"] = ("path STRING", "BOOLEAN", f"forall(split(path, '/'), x -> NOT (x IN ('', '.', '..') OR rlike(x, r'[\\\\:<>\\x22|?*\\x00-\\x1f]') OR rlike(x, r'[ .]$') OR lower(substring_index(x, '.', 1)) IN ({_DEVICES})))")
_HEAD = "hex(substring(data, 1, 16))"
_SQL["sniff"] = ("data BINARY", "STRING", f"CASE WHEN startswith({_HEAD}, '52494646') AND substring({_HEAD}, 17, 8) = '57415645' THEN 'wav' " + " ".join(f"WHEN startswith({_HEAD}, '{digits}') THEN '{kind}'" for digits, kind in L.MAGIC) + " ELSE 'other' END")


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, (takes, gives, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")

    @F.arrow_udf("double")
    def byte_entropy(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else C.entropy(x) for x in data.to_pylist()], pa.float64())

    @F.arrow_udf("int")
    def delta_stride(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else C.stride(x) for x in data.to_pylist()], pa.int32())

    @F.arrow_udf("string")
    def content_kind(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else C.classify(x[: 1 << 20])[0] for x in data.to_pylist()], pa.string())

    @F.udtf(returnType="nth int, start long, length long")
    class Chunks:
        def eval(self, data: bytes, smallest: int, average: int, largest: int):
            start = 0
            for nth, end in enumerate(cuts(bytes(data or b""), smallest, average, largest)):
                yield nth, start, end - start
                start = end

    @F.udtf(returnType="nth int, start long, length long, kind string")
    class Streams:
        def eval(self, data: bytes):
            for nth, (start, length, kind) in enumerate(C.container_streams(bytes(data or b""))):
                yield nth, start, length, kind

    @F.udtf(returnType="nth int, path string, size long, packed long")
    class ZipEntries:
        def eval(self, data: bytes):
            try:
                found = zipfile.ZipFile(io.BytesIO(data or b"")).infolist()
            except zipfile.BadZipFile:
                return
            for nth, info in enumerate(found):
                yield nth, info.filename, info.file_size, info.compress_size

    for name, f in (("byte_entropy", byte_entropy), ("delta_stride", delta_stride), ("content_kind", content_kind)):
        spark.udf.register(name, f)
    for name, f in (("cdc_chunks", Chunks), ("container_streams", Streams), ("zip_entries", ZipEntries)):
        spark.udtf.register(name, f)
    return [*_SQL, "byte_entropy", "delta_stride", "content_kind", "cdc_chunks", "container_streams", "zip_entries"]
