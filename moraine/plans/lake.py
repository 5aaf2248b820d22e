"""A versioned lake of files: generations of tables, committed by a marker.

    root/_commits/N.json     the marker of generation N, written last, by rename
    root/N/files, root/N/units   the catalogue as generation N left it
    root/N/payloads          the packed bytes of the units generation N added
    root/_lock               held by the one writer: its name and when it began

Readers take the newest marker whose catalogue verifies.  If a newer one doesn't,
they are told of the damage and writers refuse to go on.  Folders without a marker
are what a broken write left; nobody reads them, and `vacuum` removes them.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as L
from .. import model as M
from ..operators.chunking import assemble, items
from ..operators.codecs import pack_units, tourney, unpack_units
from ..operators.ordering import running, upper_median
from ..store import settled
from .queries import selected


class Damaged(Exception):
    """The newest generation can't be read."""


class Unreadable(Exception):
    """The newest generation is of a format that this version can't read."""


class Store:
    """Small files on the cluster's file system, by way of the JVM."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.conf), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def names(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, exclusive: bool = False) -> None:
        fs, path = self._at(name)
        fs.mkdirs(path.getParent())
        if exclusive:
            stream = fs.create(path, False)
            stream.write(bytearray(text.encode()))
            stream.close()
            return
        part = path.suffix(f".{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(path) or not fs.rename(part, path):
            fs.delete(part, False)
            raise FileExistsError(name)

    def size(self, name: str) -> int:
        fs, path = self._at(name)
        return fs.getContentSummary(path).getLength()

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)


def _ended(lock: dict) -> bool:
    if time.time() - lock.get("time", 0) > M.LOCK_SECONDS:
        return True
    if lock.get("host") != socket.gethostname():
        return False
    try:
        os.kill(int(lock["process"]), 0)
    except ProcessLookupError:
        return True
    except (OSError, KeyError, ValueError):
        return False
    return False


def _sum(df: DataFrame) -> str:
    """A checksum of a table's rows, whatever their order."""
    got = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0))).first()
    return f"{got[0]}:{got[1]}"


def ordered(rows: DataFrame, column: str = "path", descending: bool = False) -> DataFrame:
    """A listing by any of its columns; names by case-insensitive order first, ties by path."""
    keys = [F.lower("path"), F.col("path")] if column == "path" else [F.col(column)]
    return rows.orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys], "path")


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)
        self.damage: dict | None = None
        self._open()

    # --- generations

    @classmethod
    def create(cls, spark: SparkSession, root: str, level: str = "normal", target: int | None = None) -> Lake:
        store = Store(spark, root)
        if store.names("_commits"):
            raise FileExistsError(root)
        lake = cls.__new__(cls)
        lake.spark, lake.root, lake.store, lake.damage = spark, root.rstrip("/"), store, None
        lake.generation, lake.marker = 0, {"geometry": M.geometry(level, target), "level": level, "payloads": []}
        lake._commit(spark.createDataFrame([], M.FILES), spark.createDataFrame([], M.UNITS))
        return lake

    def _open(self) -> None:
        found = sorted((int(x[:-5]) for x in self.store.names("_commits") if x.endswith(".json") and x[:-5].isdigit()), reverse=True)
        if not found:
            raise FileNotFoundError(self.root)
        for n in found[: M.FALLBACKS]:
            try:
                marker = json.loads(self.store.read(f"_commits/{n}.json"))
                version = int(marker.get("format", 1))
                if version > M.FORMAT:
                    raise Unreadable(f"{self.root}: generation {n} is of format {version}, and this version reads up to {M.FORMAT}")
                if version < M.OLDEST:
                    raise Unreadable(f"{self.root}: generation {n} is of format {version}, and this version reads from {M.OLDEST}")
                if marker["generation"] == n and _sum(self._table("files", n)) == marker["files"] and _sum(self._table("units", n)) == marker["units"]:
                    self.generation, self.marker = n, marker
                    self.damage = None if n == found[0] else {"lost": found[0], "opened": n}
                    return
            except Unreadable:
                raise
            except Exception:  # noqa: BLE001 - any fault of a generation sends us to the one before
                continue
        raise Damaged(f"{self.root}: no generation verifies")

    def _table(self, name: str, generation: int) -> DataFrame:
        return self.spark.read.schema(M.FILES if name == "files" else M.UNITS).parquet(f"{self.root}/{generation}/{name}")

    def as_of(self, generation: int) -> tuple[DataFrame, DataFrame]:
        """The catalogue as a generation left it."""
        return self._table("files", generation), self._table("units", generation)

    @property
    def files(self) -> DataFrame:
        return self._table("files", self.generation)

    @property
    def units(self) -> DataFrame:
        return self._table("units", self.generation)

    @property
    def payloads(self) -> DataFrame:
        paths = [f"{self.root}/{n}/payloads" for n in self.marker["payloads"]]
        schema = "unit long, data binary"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def extents(self) -> DataFrame:
        return self.files.select("path", F.col("pos").alias("file_pos"), "size", F.posexplode("extents").alias("pos", "e")).select("path", "file_pos", "size", "pos", "e.unit", "e.off", "e.len")

    @contextmanager
    def _writing(self):
        if self.damage:
            raise Damaged(f"generation {self.damage['lost']} can't be read; refusing to write after {self.damage['opened']}")
        self._lock()
        try:
            newest = max(int(x[:-5]) for x in self.store.names("_commits") if x.endswith(".json"))
            if newest != self.generation:
                raise BlockingIOError(f"{self.root} is at generation {newest} by now")
            yield self.generation + 1
        finally:
            if self._holds_lock():
                self.store.delete("_lock")
            self.owner = None

    owner: str | None = None

    def _lock(self) -> None:
        """Takes the writer's lock; one that is older than `M.LOCK_SECONDS`, or whose process on this host has ended, is taken over."""
        mine = {"owner": uuid.uuid4().hex, "host": socket.gethostname(), "process": os.getpid(), "time": time.time()}
        for again in (True, False):
            try:
                self.store.write("_lock", json.dumps(mine), exclusive=True)
                self.owner = mine["owner"]
                return
            except Exception as error:
                held = self.lock()
                if held is None or not again or not _ended(held):
                    raise BlockingIOError(f"{self.root} has a writer: {held}") from error
                self.store.delete("_lock")

    def lock(self) -> dict | None:
        """Who holds the writer's lock, since when."""
        try:
            return json.loads(self.store.read("_lock"))
        except Exception:  # noqa: BLE001 - it is gone, or being written
            return None

    def _holds_lock(self) -> bool:
        return self.owner is not None and (self.lock() or {}).get("owner") == self.owner

    def _commit(self, files: DataFrame, units: DataFrame, payloads: DataFrame | None = None, only: bool = False, **more) -> None:
        n = self.generation + 1
        for name in ("files", "units"):
            self.store.delete(f"{n}/{name}")
        files, units = settled(files.select(M.FILES.names), f"{self.root}/{n}/files"), settled(units.select(M.UNITS.names), f"{self.root}/{n}/units")
        held = [] if only else list(self.marker["payloads"])
        if payloads is not None:
            payloads.select("unit", "data").write.mode("overwrite").parquet(f"{self.root}/{n}/payloads")
            held.append(n)
        marker = {k: self.marker[k] for k in ("geometry", "level")} | {"format": M.FORMAT, "generation": n, "payloads": held, "files": _sum(files), "units": _sum(units)} | more
        if self.owner is not None and not self._holds_lock():
            raise BlockingIOError(f"{self.root}: another writer has taken over")
        self.store.write(f"_commits/{n}.json", json.dumps(marker))
        self.generation, self.marker = n, marker

    def vacuum(self) -> list[str]:
        """Removes what broken writes and `test` left behind."""
        self.store.delete("_tests")
        committed = {x[:-5] for x in self.store.names("_commits")}
        gone = [x for x in self.store.names("") if x.isdigit() and x not in committed]
        for x in gone:
            self.store.delete(x)
        return gone

    # --- writing

    def add(self, entries: DataFrame, batch: int | None = None, trace: bool = False, progress: Callable[[dict], None] | None = None) -> dict:
        """Adds or replaces entries (path, content, and if there are any mtime, mtime_nanos, attrs, dir).

        A batch number makes a replay of the same batch do nothing.  With `trace` the
        generation keeps a table of its units.  `progress` is told of each phase as it
        begins (scan, work, drain, commit, done) with what is known by then.
        """
        tell = lambda phase, **known: progress({"phase": phase, "generation": self.generation, **known}) if progress else None
        if batch is not None and self.marker.get("batch", -1) >= batch:
            return {"files": 0, "dirs": 0, "bytes_in": 0, "bytes_stored": 0, "bytes_deduped": 0, "warnings": 0}
        with self._writing() as n:
            tell("scan")
            work = f"{self.root}/{n}/work"
            have = set(entries.columns)
            col = lambda name, kind, default: (F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)).cast(kind).alias(name)
            rows = entries.select(L.normalize_rel(F.col("path")).alias("path"), F.col("path").alias("given"), F.coalesce("content", F.lit(b"")).alias("content"), col("mtime", "long", 0), col("mtime_nanos", "long", 0), F.col("attrs").bitwiseAND(M.ATTRIBUTES).cast("long").alias("attrs") if "attrs" in have else F.lit(0).cast("long").alias("attrs"), col("dir", "boolean", False))
            refused = rows.where("path is null").count()
            rows = rows.where("path is not null").groupBy("path").agg(F.max_by(F.struct("content", "mtime", "mtime_nanos", "attrs", "dir"), F.struct("mtime", "mtime_nanos", F.sha2("content", 256))).alias("r")).select("path", "r.*")
            rows = settled(rows, f"{work}/rows")  # read several times below
            if progress:
                tell("work", **rows.agg(F.count_if(~F.col("dir")).alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes_in")).first().asDict())
            shape = self.marker["geometry"]
            parts = settled(items(rows.where("not dir"), shape), f"{work}/items")
            placed = settled(assemble(parts, shape["target"]), f"{work}/placed")
            local = placed.select("group", "deal", "local").distinct()
            numbered = settled(running(local, ["group", "deal", "local"], f"{work}/order", number="seq"), f"{work}/numbered")
            unit_of = placed.join(numbered, ["group", "deal", "local"]).select("path", "nth", "seq", "off", "len")
            data = parts.select("path", "nth", "content").join(unit_of.select("path", "nth", "seq", "off"), ["path", "nth"])
            joined = data.groupBy(F.col("seq").alias("unit")).agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY off)").alias("data"))
            staged = settled(joined.withColumn("hash", F.substring(F.sha2("data", 256), 1, 32)), f"{work}/staged")
            # The last of equal units in the lake stands for a hash; else the first of this run does.
            known = self.units.groupBy("hash").agg(F.max("unit").alias("known"))
            first = staged.groupBy("hash").agg(F.min("unit").alias("first"), F.first(F.octet_length("data")).alias("len"), F.count(F.lit(1)).alias("copies")).join(known, "hash", "left")
            if trace:
                kind = F.min(F.when(F.col("size") >= M.CONFIDENT, F.col("kind")))
                assembled = placed.join(numbered, ["group", "deal", "local"]).groupBy(F.col("seq").alias("unit")).agg(F.sum("len").alias("len"), F.count(F.lit(1)).alias("items"), F.max("cut").alias("cut"), F.coalesce(kind, F.lit("-")).alias("kind"), F.count_distinct(L.group_key(F.col("path"))).alias("exts"))
                told = staged.select("unit", "hash").join(first.select("hash", "first", "known"), "hash").select("unit", (F.col("known").isNotNull() | (F.col("unit") != F.col("first"))).alias("deduped"))
                settled(assembled.join(told, "unit").select("unit", "len", "items", "cut", "kind", "deduped", "exts"), f"{self.root}/{n}/unit_trace")
            base = (self.units.agg(F.max("unit")).first()[0] if not self.units.isEmpty() else -1) + 1
            fresh = settled(running(first.where("known is null").select("hash", "first"), ["first"], f"{work}/fresh-order", number="rank"), f"{work}/fresh")
            mapping = staged.select(F.col("unit").alias("seq"), "hash").join(first.select("hash", "known"), "hash").join(fresh.select("hash", "rank"), "hash", "left").select("seq", F.coalesce("known", F.col("rank") + base).alias("unit"))
            packed = staged.join(fresh.select(F.col("first").alias("unit"), "rank"), "unit").select((F.col("rank") + base).alias("unit"), "data")
            # Every chunk of a file that is large enough votes for its unit's kind and filter, by its bytes.
            votes = parts.where(F.col("size") >= M.CONFIDENT).select("path", "nth", "len", "kind", "filter").join(unit_of.select("path", "nth", "seq"), ["path", "nth"]).groupBy("seq", "kind", "filter").agg(F.sum("len").alias("n"))
            vote = votes.groupBy(F.col("seq").alias("first")).agg(F.min(F.struct((-F.col("n")).alias("n"), "filter", "kind")).alias("v")).select("first", "v.kind", "v.filter")
            packed = packed.join(vote.join(fresh.select("first", "rank"), "first").select((F.col("rank") + base).alias("unit"), "kind", "filter"), "unit", "left")
            packed = settled(pack_units(packed.repartition("unit"), self.marker["level"]), f"{work}/packed")
            tell("drain")
            extents = unit_of.join(mapping, "seq").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("nth", F.struct("unit", "off", "len").alias("e")))).alias("x")).select("path", F.transform("x", lambda x: x["e"]).alias("extents"))
            new = rows.select("path", F.octet_length("content").cast("long").alias("size"), "mtime", "mtime_nanos", "attrs", "dir").join(extents, "path", "left").withColumn("extents", F.coalesce("extents", F.array().cast(M.FILES["extents"].dataType)))
            top = (self.files.agg(F.max("pos")).first()[0] if not self.files.isEmpty() else -1) + 1
            old = self.files
            fresh_paths = settled(running(new.join(old.select("path"), "path", "left_anti").select("path"), ["path"], f"{work}/pos", number="pos").withColumn("pos", F.col("pos") + top), f"{work}/new-pos")
            where = old.select("path", "pos").unionByName(fresh_paths.select("path", "pos"))
            files = new.join(where, "path").select(M.FILES.names).unionByName(old.join(new.select("path"), "path", "left_anti"))
            sums = staged.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
            stored = packed.agg(F.coalesce(F.sum("unpacked"), F.lit(0)), F.coalesce(F.sum("packed"), F.lit(0))).first()
            counts = new.agg(F.count_if(~F.col("dir")), F.count_if("dir")).first()
            tell("commit", bytes_stored=stored[1])
            self._commit(settled(files, f"{work}/files"), self.units.unionByName(packed.select(M.UNITS.names)), packed, **({"batch": batch} if batch is not None else {k: self.marker[k] for k in ("batch",) if k in self.marker}))
            self.store.delete(f"{n}/work")
            tell("done", files=counts[0], bytes_in=sums, bytes_stored=stored[1])
            return {"files": counts[0], "dirs": counts[1], "bytes_in": sums, "bytes_stored": stored[1], "bytes_deduped": sums - stored[0], "warnings": refused}

    def _picked(self, selectors: list[str]) -> DataFrame:
        given = self.spark.createDataFrame([(x,) for x in selectors], "sel string")
        hit = selected(self.files, given)
        missing = given.select(L.normalize_selector(F.col("sel")).alias("sel")).distinct().join(hit, "sel", "left_anti").orderBy("sel")
        names = [r.sel for r in missing.collect()]  # no more than the caller named
        if names:
            raise KeyError(f"nothing matches {', '.join(names)}")
        return hit.select("path").distinct()

    def remove(self, selectors: list[str]) -> int:
        """Drops entries; their units stay until `compact`."""
        with self._writing():
            gone = self._picked(selectors)
            count = gone.count()
            if count:
                self._commit(self.files.join(gone, "path", "left_anti"), self.units)
            return count

    def rename(self, source: str, target: str) -> int:
        """Moves an entry or a folder; the index changes and nothing else."""
        source, target = (x.replace("\\", "/").rstrip("/") for x in (source, target))
        if source == target:
            return 0
        if not source or not target:
            raise ValueError("a name is empty")
        if target.startswith(source + "/"):
            raise ValueError(f"{source} can't move into itself")
        if not self.spark.range(1).select(L.path_ok(F.lit(target))).first()[0]:
            raise ValueError(f"{target} is not a safe path")
        with self._writing():
            hit = (F.col("path") == source) | F.col("path").startswith(source + "/")
            moved = self.files.where(hit).withColumn("path", F.concat(F.lit(target), F.substring(F.col("path"), len(source) + 1, 1 << 30)))
            still = self.files.where(~hit)
            count = moved.count()
            if not count:
                raise KeyError(f"nothing matches {source}")
            clash = moved.select(F.lower("path").alias("k")).join(still.select(F.lower("path").alias("k")), "k", "left_semi")
            twice = moved.groupBy(F.lower("path")).count().where("count > 1")
            # A file can't be some other entry's folder, nor stand in a file.
            above = lambda x: F.explode(F.slice(L.ancestors(F.col("path")), F.lit(1), F.size(F.split("path", "/")) - 1)).alias("path")
            nested = moved.where("not dir").select("path").join(still.select(above(still)), "path", "left_semi").union(still.where("not dir").select("path").join(moved.select(above(moved)), "path", "left_semi"))
            if not (clash.isEmpty() and twice.isEmpty() and nested.isEmpty()):
                raise FileExistsError(f"{target} is taken")
            self._commit(moved.unionByName(still), self.units)
            return count

    def compact(self, history: bool = False) -> tuple[int, int]:
        """Drops dead units; live ones are verified and numbered by their first use.  Bytes before and after.

        Once the new generation is committed, those before it and their bytes go, unless `history` keeps them.
        """
        with self._writing() as n:
            before = self.units.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
            first = self.extents.groupBy("unit").agg(F.min(F.struct("file_pos", "pos")).alias("f")).select("unit", "f.file_pos", "f.pos")
            order = settled(running(first, ["file_pos", "pos", "unit"], f"{self.root}/{n}/work", number="new"), f"{self.root}/{n}/work-order")
            bad = self.verdicts().where("why is not null")
            if not bad.isEmpty():
                raise Damaged("a live unit doesn't verify; nothing was changed")
            units = self.units.join(order.select("unit", "new"), "unit").drop("unit").withColumnRenamed("new", "unit")
            payloads = self.payloads.join(order.select("unit", "new"), "unit").select(F.col("new").alias("unit"), "data")
            moved = self.files.select("*", F.posexplode_outer("extents").alias("i", "e")).join(order.select(F.col("unit").alias("old"), "new"), F.col("e.unit") == F.col("old"), "left")
            plain = [c for c in M.FILES.names if c != "extents"]
            files = moved.groupBy(*plain).agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", F.struct(F.col("new").alias("unit"), F.col("e.off").alias("off"), F.col("e.len").alias("len")).alias("e"))))).alias("x"))
            files = files.select(*plain, F.transform("x", lambda x: x["e"]).alias("extents"))
            self._commit(settled(files.select(M.FILES.names), f"{self.root}/{n}/work-files"), units, settled(payloads, f"{self.root}/{n}/work-payloads"), only=True)
            for x in ("work", "work-order", "work-files", "work-payloads"):
                self.store.delete(f"{n}/{x}")
            if not history:
                # Markers first: a reader that finds none of a generation doesn't look for its tables.
                past = [x for x in self.store.names("_commits") if x.endswith(".json") and x[:-5].isdigit() and int(x[:-5]) < n]
                for x in past:
                    self.store.delete(f"_commits/{x}")
                for x in past:
                    self.store.delete(x[:-5])
            return before, self.units.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]

    # --- reading

    def listing(self, selectors: list[str] | None = None) -> DataFrame:
        """(path, size, stored, solid, dir) of every entry."""
        files = self.files if selectors is None else self.files.join(self._picked(selectors), "path")
        joined = files.select("path", "size", "dir", F.size("extents").alias("n"), F.explode_outer("extents").alias("e")).join(self.units.select("unit", "packed", "unpacked"), F.col("e.unit") == F.col("unit"), "left")
        stored = F.coalesce(F.sum(L.stored_bytes(F.col("packed"), F.col("unpacked"), F.col("e.len"))), F.lit(0))
        solid = F.when(F.col("n") < 1, False).when(F.col("n") == 1, F.max("unpacked") != F.col("size")).otherwise(True)
        return joined.groupBy("path", "size", "dir", "n").agg(stored.alias("stored"), solid.alias("solid")).select("path", "size", "stored", "solid", "dir")

    def folders(self, selectors: list[str] | None = None) -> DataFrame:
        """(path, mtime, mtime_nanos, attrs) of the stored folders."""
        files = self.files if selectors is None else self.files.join(self._picked(selectors), "path")
        return files.where("dir").select("path", "mtime", "mtime_nanos", "attrs")

    def stranded(self) -> int:
        """Bytes in generations that no marker up to the opened one names: what broken or damaged writes left."""
        held = {x[:-5] for x in self.store.names("_commits") if x.endswith(".json") and x[:-5].isdigit() and int(x[:-5]) <= self.generation}
        return sum(self.store.size(x) for x in self.store.names("") if x.isdigit() and x not in held)

    def live(self) -> DataFrame:
        return self.units.join(self.extents.select("unit").distinct(), "unit", "left_semi")

    def info(self) -> DataFrame:
        live, length = self.live(), self.units.agg(F.coalesce(F.sum("packed"), F.lit(0)).alias("n")).scalar()
        sums = live.agg(F.count(F.lit(1)).alias("live_units"), F.coalesce(F.sum("packed"), F.lit(0)).alias("live_bytes"), F.coalesce(F.min("unpacked"), F.lit(0)).alias("smallest"), F.coalesce(F.max("unpacked"), F.lit(0)).alias("largest"), F.coalesce(F.bool_or(F.col("codec").between(2, 4)), F.lit(False)).alias("slow"), F.coalesce(F.bool_or(F.col("codec") == M.BWT), F.lit(False)).alias("hungry"))
        files = self.files.agg(F.count_if(~F.col("dir")).alias("n")).scalar()
        dirs = self.files.agg(F.count_if("dir").alias("n")).scalar()
        return sums.select(F.lit(self.generation).cast("long").alias("generation"), files.alias("files"), dirs.alias("dirs"), "live_units", length.alias("stored_bytes"), "live_bytes", (length - F.col("live_bytes")).alias("reclaimable"), "smallest", upper_median(live, "unpacked").alias("median"), "largest", "slow", "hungry")

    def unit_report(self) -> DataFrame:
        """One row per live unit, with its members and the commonest extension."""
        members = self.extents.select("unit", "path", L.group_key(F.col("path")).alias("ext")).distinct().groupBy("unit", "ext").agg(F.count(F.lit(1)).alias("n"))
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col("ext").alias("ext")))["ext"]
        report = members.groupBy("unit").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("exts"), F.when(best == "", "-").otherwise(best).alias("top_ext"))
        return self.units.join(report, "unit").select("unit", "unpacked", "packed", L.codec_name(F.col("codec")).alias("codec"), "param", "filter", "files", "exts", "top_ext")

    def unit_trace(self, generation: int | None = None) -> DataFrame:
        """(unit, len, items, cut, kind, deduped, exts) of the units that an `add` with `trace` assembled."""
        return self.spark.read.parquet(f"{self.root}/{generation or self.generation}/unit_trace")

    def tourney_trace(self, level: str | None = None) -> DataFrame:
        """(unit, kind, filter, unpacked, fed, codec, param, coded, ms): every codec that races for each live unit, run again."""
        live = unpack_units(self.live().join(self.payloads, "unit"))
        return tourney(live.where("why is null").join(self.units.select("unit", "filter"), "unit"), level or self.marker["level"])

    def verdicts(self) -> DataFrame:
        """(unit, unpacked, why) of every live unit, and of units that extents name but nothing holds."""
        live = self.extents.select("unit").distinct().join(self.units, "unit", "left").join(self.payloads, "unit", "left")
        known = live.where("hash is not null")
        lost = live.where("hash is null").select("unit", F.lit("it is not in the catalogue").alias("why"))
        checked = unpack_units(known).select("unit", "why").unionByName(lost)
        return checked.join(self.units.select("unit", "unpacked"), "unit", "left")

    def test(self) -> tuple[DataFrame, DataFrame]:
        """Totals, and the entries that lost bytes."""
        got = settled(self.verdicts(), f"{self.root}/_tests/{uuid.uuid4().hex}")
        bad = got.where("why is not null")
        totals = got.agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("why").isNull()).alias("ok"), F.coalesce(F.sum(F.when(F.col("why").isNull(), F.col("unpacked"))), F.lit(0)).alias("bytes_ok"))
        return totals, self.extents.join(bad.select("unit", "why"), "unit").groupBy("path").agg(F.min("why").alias("why"), F.min("file_pos").alias("file_pos"))

    def bad_units(self) -> DataFrame:
        """(unit, why) of the live units that don't verify, in order."""
        return self.verdicts().where("why is not null").select("unit", "why").orderBy("unit")

    def contents(self, selectors: list[str] | None = None) -> DataFrame:
        """(path, size, content, why): each unit is opened once, and its pieces go to their files."""
        picked = self.files.where("not dir") if selectors is None else self.files.where("not dir").join(self._picked(selectors), "path")
        pieces = picked.select("path", F.posexplode("extents").alias("pos", "e")).select("path", "pos", "e.unit", "e.off", "e.len")
        needed = self.units.join(pieces.select("unit").distinct(), "unit", "left_semi").join(self.payloads, "unit", "left")
        opened = unpack_units(needed)
        cut = pieces.join(opened, "unit", "left").select("path", "pos", F.substring(F.col("data"), (F.col("off") + 1).cast("int"), F.col("len").cast("int")).alias("piece"), F.when(F.col("data").isNull(), F.coalesce("why", F.lit("a unit is not in the catalogue"))).alias("why"))
        whole = cut.groupBy("path").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY pos)").alias("whole"), F.min("why").alias("why"))
        joined = picked.select("path", "size", "pos", "mtime", "mtime_nanos", "attrs").join(whole, "path", "left")
        content = F.when(F.col("why").isNull(), F.coalesce("whole", F.lit(b"")))
        out = joined.select("path", "size", "pos", "mtime", "mtime_nanos", "attrs", content.alias("content"), "why")
        return out.withColumn("why", F.when(F.col("why").isNull() & (F.octet_length("content") != F.col("size")), "its length differs").otherwise(F.col("why")))
