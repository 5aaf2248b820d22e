"""Content-defined chunks, and their assembly into units.

Files below a size, and recompressible ones, are one item each; others are cut
where a rolling hash of the last 64 bytes has enough zero bits, so an edit moves
the cuts around it only.  Items are placed in order into units by a fold over
their lengths and hashes; the fold runs per group of one extension in one folder
(and per bucket of a folder beyond `CROWD` items), and needs no bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as L
from .. import model as M
from .codecs import batched, classify, wav_probe

CROWD = 100_000
_ITEM = pa.schema([("path", pa.string()), ("nth", pa.int32()), ("len", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("kind", pa.string()), ("alone", pa.bool_()), ("filter", pa.int32()), ("content", pa.binary())])
_GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear %d" % i).digest()[:8] for i in range(256)), "<u8")


def rolling(data: bytes) -> np.ndarray:
    """For each place the gear hash of the 64 bytes up to it, by doubling."""
    h = _GEAR[np.frombuffer(data, np.uint8)].copy()
    with np.errstate(over="ignore"):
        for k in (1, 2, 4, 8, 16, 32):
            if len(h) > k:
                h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    return h


def cuts(data: bytes, smallest: int, average: int, largest: int) -> list[int]:
    """The ends of the chunks.  Below the average size a cut needs two bits more, above it two bits fewer."""
    bits = max(1, average.bit_length() - 1)
    h = rolling(data)
    zero = lambda n: np.flatnonzero(h >> np.uint64(64 - n) == 0) + 1
    hard, easy = zero(min(bits + 2, 60)), zero(max(bits - 2, 1))
    out, at = [], 0
    while at < len(data):
        end = min(at + largest, len(data))
        i = np.searchsorted(hard, at + smallest)
        cut = int(hard[i]) if i < len(hard) and hard[i] <= at + average else None
        if cut is None:
            i = np.searchsorted(easy, at + max(smallest, average))
            cut = int(easy[i]) if i < len(easy) and easy[i] < end else end
        at = min(cut, end)
        out.append(at)
    return out


def wav_runs(data: bytes, unit: int) -> list[int] | None:
    """The ends of runs of whole PCM frames of at most `unit` bytes; the header rides with the first, what follows the samples with the last."""
    found = wav_probe(data)
    if found is None:
        return None
    frame = found["channels"] * found["bits"] // 8
    first, last = found["data"], found["data"] + found["size"] // frame * frame
    if first + frame > unit or len(data) - last + frame > unit:
        return None
    ends = list(range(first + (unit - first) // frame * frame, last, unit // frame * frame))
    if ends and len(data) - ends[-1] > unit:
        ends.append(ends[-1] + (last - ends[-1]) // frame // 2 * frame)
    return [*ends, len(data)]


def items(entries: DataFrame, geometry: dict[str, int]) -> DataFrame:
    """(path, content) -> (path, nth, len, size, digest, kind, alone, filter, content): the items of each file that is not empty."""
    shape = dict(geometry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    data, path = batch.column("content")[i].as_py(), batch.column("path")[i].as_py()
                    if not data:
                        continue
                    kind, wanted = classify(data[: 1 << 20])
                    whole = kind in ("container", "jpeg", "wav", "mp3") and len(data) <= min(2 * shape["target"], M.STORED_MAX)
                    pcm = wav_runs(data, shape["target"]) if kind == "wav" and not whole else None
                    ends = pcm if pcm else [len(data)] if len(data) < shape["chunked_from"] or whole else cuts(data, shape["chunk_min"], shape["chunk_avg"], shape["chunk_max"])
                    alone = (kind == "store" and len(data) >= shape["chunked_from"]) or len(data) >= shape["target"] // 2 or (whole and len(data) >= M.OWN_UNIT)
                    start = 0
                    for nth, end in enumerate(ends):
                        part = data[start:end]
                        yield {"path": path, "nth": nth, "len": len(part), "size": len(data), "digest": hashlib.sha256(part).hexdigest(), "kind": kind, "alone": alone, "filter": wanted, "content": part}
                        start = end

        yield from batched(cut(), _ITEM, "content")

    return entries.select("path", "content").mapInArrow(run, "path string, nth int, len long, size long, digest string, kind string, alone boolean, filter int, content binary")


def fold(rows: list[tuple[str, int, int, str, str, bool]], target: int) -> list[tuple[int, int, str]]:
    """(unit, offset, why it was closed) of each (path, length, file size, digest, kind, alone), in order."""
    placed: list[list] = []
    unit = held = opened = 0
    klass = solo = None

    def close(why: str) -> None:
        nonlocal unit, held, klass, opened
        if held:
            for x in placed[opened:]:
                x[2] = why
            unit, held, klass, opened = unit + 1, 0, None, len(placed)

    for path, length, size, digest, kind, alone in rows:
        if solo is not None and solo != path:
            close("solo")
            solo = None
        if alone and solo is None:
            close("before-solo")
            solo = path
        confident = size >= M.CONFIDENT
        if confident and klass not in (None, kind):
            close("class")
        if held and held + length > 2 * target:
            close("overshoot")
        if confident and klass is None:
            klass = kind
        placed.append([unit, held, "end"])
        held += length
        number = int.from_bytes(bytes.fromhex(digest[:16]), "little")  # unsigned
        if held >= target // 2 and number % target < length:
            close("hash")
        elif held >= 2 * target:
            close("cap")
    return [tuple(x) for x in placed]


def assemble(parts: DataFrame, target: int) -> DataFrame:
    """Adds to (path, nth, len, size, digest, kind, alone) its group, the unit in it, the offset, and why the unit was closed."""
    keyed = parts.withColumn("group", F.concat_ws("\x00", L.group_key(F.col("path")), F.regexp_replace("path", "/?[^/]*$", "")))
    crowds = keyed.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("deals"))
    dealt = keyed.join(crowds, "group").withColumn("deal", F.pmod(F.xxhash64("path"), F.col("deals")).cast("int")).drop("deals")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("path", "ascending"), ("nth", "ascending")])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("path", "len", "size", "digest", "kind", "alone"))))
        placed = fold(rows, target)
        out = table.select(["path", "nth", "len", "size", "digest", "kind", "group", "deal"])
        for name, i, kind in (("local", 0, pa.int64()), ("off", 1, pa.int64()), ("cut", 2, pa.string())):
            out = out.append_column(name, pa.array([x[i] for x in placed], kind))
        return out

    schema = "path string, nth int, len long, size long, digest string, kind string, group string, deal int, local long, off long, cut string"
    return dealt.select("path", "nth", "len", "size", "digest", "kind", "alone", "group", "deal").groupBy("group", "deal").applyInArrow(run, schema)
