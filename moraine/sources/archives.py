"""File trees and foreign archives as sources and sinks.

What a file is is told by its first bytes, never by its name; only creating looks at
the name.  Zip archives are listed, read and written; 7z and RAR archives are
recognised and refused by name, as no library here reads them.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as L
from ..operators.codecs import batched

#: The bit of the attributes that means read-only (fixed value).
READ_ONLY = 1
ZIP_LEVELS = {"fast": 1, "normal": 6, "max": 9}
_REFUSED = {"7z": "7z archives can't be read: no 7z library is installed", "rar": "RAR archives can't be read: this build has no RAR support"}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, mtime_nanos, content, dir) of every file and folder below a folder, named from the folder's own name on.

    Spark's reader leaves out empty files and folders; those come from a listing by
    the driver, which lists the files for the reader as well.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    micros = F.unix_micros("modificationTime")
    relative = F.concat(F.lit(base), F.substring_index(F.col("path"), f"/{base}", -1))
    full = files.select(relative.alias("path"), F.col("length").alias("size"), F.floor(micros / 1_000_000).alias("mtime"), (F.pmod(micros, F.lit(1_000_000)) * 1000).alias("mtime_nanos"), "content", F.lit(False).alias("dir"))
    store, top = pyarrow.fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    found = store.get_file_info(pyarrow.fs.FileSelector(top, recursive=True))
    rest = [(f"{base}/{x.path[len(top.rstrip('/')) + 1:]}", x.mtime_ns or 0, x.type == pyarrow.fs.FileType.Directory) for x in found if x.type == pyarrow.fs.FileType.Directory or not x.size]
    schema = "path string, size long, mtime long, mtime_nanos long, content binary, dir boolean"
    return full.unionByName(spark.createDataFrame([(path, 0, ns // 10**9, ns % 10**9, b"", folder) for path, ns, folder in rest], schema))


def kinds(spark: SparkSession, paths: str) -> DataFrame:
    """(path, kind) of each file, from its content."""
    return spark.read.format("binaryFile").load(paths).select("path", L.sniff(F.col("content")).alias("kind"))


_MEMBER = pa.schema([("archive", pa.string()), ("nth", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("why", pa.string())])


def _members(data: bytes) -> Iterator[tuple[str, bytes | None, int, str | None]]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in archive.infolist():
                name = info.orig_filename.replace("\\", "/")
                if name.endswith("/"):
                    continue
                try:
                    yield name, archive.read(info), info.file_size, None
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as error:
                    yield name, None, info.file_size, str(error)
    except zipfile.BadZipFile as error:
        yield "", None, 0, str(error)


def read_archives(spark: SparkSession, paths: str) -> DataFrame:
    """(archive, path, size, content, why): members in the order of the central directory, `nth` telling it; folders are left out.

    Unsafe names, names that differ from an earlier one in case only, damaged
    members and archives of other formats come with a reason and no content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in ("path", "kind", "content")}
                    found = _members(row["content"]) if row["kind"] == "zip" else iter([("", None, 0, _REFUSED.get(row["kind"], f"not an archive: {row['kind']}"))])
                    seen: set[str] = set()
                    for nth, (name, data, size, why) in enumerate(found):
                        if name and name.lower() in seen:
                            data, why = None, "another entry has this name"
                        seen.add(name.lower())
                        yield {"archive": row["path"], "nth": nth, "path": name, "size": size, "content": data, "why": why}

        yield from batched(members(), _MEMBER, "content")

    files = spark.read.format("binaryFile").load(paths).select("path", L.sniff(F.col("content")).alias("kind"), "content")
    rows = files.mapInArrow(run, "archive string, nth int, path string, size long, content binary, why string")
    safe = L.path_ok(F.col("path"))
    why = F.coalesce("why", F.when(~safe, "its name is not safe"))
    return rows.select("archive", "nth", "path", "size", F.when(why.isNull(), F.col("content")).alias("content"), why.alias("why"))


def create_zips(entries: DataFrame, folder: str, level: str = "normal", archive: str = "archive") -> DataFrame:
    """Writes one zip for each value of the column `archive` (a name below `folder`); returns (archive, members, bytes).

    Members are deflated in path order; of names that differ in case only the first
    stays; an archive that exists is never overwritten.
    """
    grade = ZIP_LEVELS[level]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("path")
        name = table.column("archive")[0].as_py()
        store, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        target = f"{root}/{name}"
        if store.get_file_info(target).type != pyarrow.fs.FileType.NotFound:
            raise FileExistsError(target)
        held, seen = io.BytesIO(), set()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED, compresslevel=grade) as out:
            for batch in table.to_batches():
                for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    if path.lower() not in seen:
                        seen.add(path.lower())
                        out.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), data or b"", zipfile.ZIP_DEFLATED, grade)
        store.create_dir(target.rsplit("/", 1)[0], recursive=True)
        part = f"{target}.part"
        with store.open_output_stream(part) as sink:
            sink.write(held.getbuffer())
        store.move(part, target)
        return pa.table({"archive": [name], "members": pa.array([len(seen)], pa.int64()), "bytes": pa.array([held.tell()], pa.int64())})

    return entries.select(F.col(archive).alias("archive"), "path", "content").groupBy("archive").applyInArrow(run, "archive string, members long, bytes long")


_META = ("mtime", "mtime_nanos", "attrs")


def _meta(rows: DataFrame) -> list:
    return [(F.col(x) if x in rows.columns else F.lit(None)).cast("long").alias(x) for x in _META]


def _restore(store: pyarrow.fs.FileSystem, target: str, mtime: int | None, nanos: int | None, attrs: int | None) -> None:
    """Time first, read-only last.  A time of 0 isn't known."""
    if not isinstance(store, pyarrow.fs.LocalFileSystem):
        return
    if mtime:
        ns = mtime * 10**9 + (nanos or 0)
        os.utime(target, ns=(ns, ns))
    if (attrs or 0) & READ_ONLY:
        os.chmod(target, os.stat(target).st_mode & ~0o222)


def extract_folders(folders: DataFrame, folder: str) -> int:
    """Makes (path[, mtime, mtime_nanos, attrs]) of folders below a folder, empty ones too; how many.

    To be called once the files are written: times and attributes come last, the
    deepest folders first, one depth at a time, as a change inside a folder changes its time.
    """
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    store, root = pyarrow.fs.FileSystem.from_uri(uri)
    safe = folders.where(L.path_ok(F.col("path"))).select("path", *_meta(folders), L.depth(F.col("path")).alias("depth"))

    def made(batches: Iterator[pa.RecordBatch], restore: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *meta in zip(*(batch.column(c).to_pylist() for c in ("path", *_META))):
                if restore:
                    _restore(store, f"{root}/{path}", *meta)
                else:
                    store.create_dir(f"{root}/{path}", recursive=True)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    def run(rows: DataFrame, restore: bool) -> int:
        return rows.select("path", *_META).mapInArrow(lambda batches: made(batches, restore), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    count = run(safe, False)
    if isinstance(store, pyarrow.fs.LocalFileSystem) and count:
        for level in range(safe.agg(F.max("depth")).first()[0], 0, -1):
            run(safe.where(F.col("depth") == level), True)
    return count


def extract(contents: DataFrame, folder: str, policy: str = "fail") -> DataFrame:
    """Writes (path, content, why, and if there are any mtime, mtime_nanos, attrs) below a folder; returns (path, bytes, outcome).

    `policy` is fail, skip or force.  With fail, all targets are looked at before
    anything is written.  Entries with a reason or an unsafe name are reported and
    skipped; of names that differ in case only the first in order is written.  On
    local file systems times come back, then the read-only attribute; others keep none.
    """
    if policy not in ("fail", "skip", "force"):
        raise ValueError(policy)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    store, root = pyarrow.fs.FileSystem.from_uri(uri)
    rows = contents.withColumn("why", F.coalesce("why", F.when(~L.path_ok(F.col("path")), "its name is not safe")))
    first = rows.groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("first"))
    rows = rows.join(first, F.lower("path") == F.col("key")).withColumn("why", F.coalesce("why", F.when(F.col("path") != F.col("first"), "another entry has this name")))

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_pydict({"path": pa.array([x for x in names if store.get_file_info(f"{root}/{x}").type != pyarrow.fs.FileType.NotFound], pa.string())})

    if policy == "fail" and not (taken := rows.where("why is null").select("path").mapInArrow(there, "path string").limit(1)).isEmpty():
        raise FileExistsError(taken.first().path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, data, why, *meta in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "why", *_META))):
                outcome, n = why, 0
                if why is None:
                    target = f"{root}/{path}"
                    if policy != "force" and store.get_file_info(target).type != pyarrow.fs.FileType.NotFound:
                        outcome = "skipped"
                    else:
                        store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                        with store.open_output_stream(f"{target}.part") as sink:
                            sink.write(data or b"")
                        store.move(f"{target}.part", target)
                        _restore(store, target, *meta)
                        outcome, n = "written", len(data or b"")
                out.append((path, n, outcome))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], ["path", "bytes", "outcome"])

    return rows.select("path", "content", "why", *_meta(rows)).mapInArrow(run, "path string, bytes long, outcome string")
