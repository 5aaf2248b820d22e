"""The lake's tables, ids and bounds."""

from __future__ import annotations

from pyspark.sql import types as T

#: Bounds that are part of the format (fixed values).
UNIT_MAX, STORED_MAX, CODED_MAX = 32 << 20, 64 << 20, 256 << 20
CONFIDENT, OWN_UNIT = 4096, 64 << 10
HEADER_BYTES, FOOTER_BYTES = 16, 80
ATTRIBUTES = 0x2007
DELTA_MAX = 32
FALLBACKS = 64
#: The format that markers name, and the oldest that is still read.  Markers without one are of the first.
FORMAT, OLDEST = 2, 1
#: A writer's lock that is older than so many seconds may be taken over.
LOCK_SECONDS = 24 * 3600

#: Codec ids.  3 and 4 are reserved for codecs without a library here and are never written; 64 is ours.
STORE, ZSTD, LZMA2, PPMD, BWT, BZ2 = 0, 1, 2, 3, 4, 64
CODECS = {STORE: "store", ZSTD: "zstd", LZMA2: "lzma2", PPMD: "ppmd7", BWT: "bwt", BZ2: "bz2"}
WRITTEN = (STORE, ZSTD, LZMA2, BZ2)

#: Filter ids.  2 to 33 are delta distances 1 to 32; 34, 35 and 37 are reserved; ids from 64 are ours.
PLAIN, X86, DELTA_1, X86_SPLIT, MP3_PLANES, WAV_PREDICT, INFLATE, PNG_JOIN = 0, 1, 2, 36, 39, 64, 65, 66

#: Unit targets and zstd levels of the three levels.
TARGETS = {"fast": 4 << 20, "normal": 16 << 20, "max": 32 << 20}
ZSTD_LEVELS = {"fast": 3, "normal": 12, "max": 19}
LZMA_PRESETS = {"fast": 2, "normal": 6, "max": 6}

EXTENT = T.StructType([T.StructField("unit", T.LongType()), T.StructField("off", T.LongType()), T.StructField("len", T.LongType())])
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()),
        T.StructField("mtime_nanos", T.LongType()), T.StructField("attrs", T.LongType()), T.StructField("dir", T.BooleanType()), T.StructField("extents", T.ArrayType(EXTENT)),
    ]
)
UNITS = T.StructType(
    [
        T.StructField("unit", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("packed", T.LongType()), T.StructField("unpacked", T.LongType()),
        T.StructField("filtered", T.LongType()), T.StructField("codec", T.IntegerType()), T.StructField("param", T.IntegerType()), T.StructField("filter", T.IntegerType()),
    ]
)


def geometry(level: str, target: int | None = None) -> dict[str, int]:
    """Chunk sizes and unit target of a lake; fixed when it is created."""
    unit = target or TARGETS[level]
    return {"chunk_min": max(64, unit // 64), "chunk_avg": max(256, unit // 16), "chunk_max": max(1024, unit // 4), "target": unit, "chunked_from": max(1024, unit // 4)}
