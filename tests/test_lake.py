"""A lake from creation to compaction, damage and replay."""

import os

import pytest
from pyspark.sql import functions as F

from moraine.plans.lake import Damaged, Lake, Unreadable
from moraine.sources.archives import create_zips, extract, read_archives, scan
from moraine.streaming.ingest import files, ingest

ENTRIES = [("src/docs/a.txt", b"words and words " * 900), ("src/docs/sub/b.txt", b"other words " * 300), ("src/pic.bin", os.urandom(30_000)), ("src/empty.dat", b""), ("src/copy.bin", None)]


def _entries(spark, rows=None):
    rows = [(p, d) for p, d in (rows or ENTRIES)]
    return spark.createDataFrame(rows, "path string, content binary")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('lake')}/one"
    lake = Lake.create(spark, root, "fast", target=16_384)
    lake.add(_entries(spark, [*ENTRIES[:4], ("src/copy.bin", ENTRIES[2][1])]))
    return root


def _contents(lake):
    return {r.path: bytes(r.content) for r in lake.contents().collect() if r.why is None}


def test_round_trip_dedup_and_edit(spark, root):
    lake = Lake(spark, root)
    assert lake.generation == 2
    got = _contents(lake)
    assert got["src/docs/a.txt"] == ENTRIES[0][1] and got["src/copy.bin"] == ENTRIES[2][1] and got["src/empty.dat"] == b""
    before = lake.units.count()
    stats = lake.add(_entries(spark, [("src/again.bin", ENTRIES[2][1]), ("../evil", b"x")]))
    assert stats["bytes_deduped"] >= 30_000 and stats["warnings"] == 1 and lake.units.count() == before
    assert _contents(lake)["src/again.bin"] == ENTRIES[2][1]
    assert lake.as_of(2)[0].count() == 5 and lake.files.count() == 6


def test_remove_rename_compact(spark, root):
    lake = Lake(spark, root)
    with pytest.raises(KeyError):
        lake.remove(["src/docs", "src/nope"])
    assert lake.files.where("path = 'src/docs/a.txt'").count() == 1
    with pytest.raises(ValueError):
        lake.rename("src", "src/b")
    with pytest.raises(FileExistsError):
        lake.rename("src/pic.bin", "SRC/COPY.bin")
    with pytest.raises(FileExistsError):
        lake.rename("src/pic.bin", "src/docs")
    assert lake.rename("src", "Src") >= 5 and lake.rename("Src", "Src") == 0
    assert lake.remove(["Src\\docs\\"]) == 2
    before, after = lake.compact()
    assert after < before
    totals = lake.test()[0].first()
    assert totals.units == totals.ok == lake.units.count()
    assert _contents(lake)["Src/copy.bin"] == ENTRIES[2][1]
    info = lake.info().first()
    assert info.reclaimable == 0 and info.files == lake.files.count()
    assert lake.unit_report().count() == totals.units and lake.listing(["Src/copy.bin"]).first().size == 30_000


def test_damage_and_locks(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    lake = Lake.create(spark, root, "fast", target=8192)
    lake.add(_entries(spark, ENTRIES[:2]))
    with pytest.raises(FileExistsError):
        Lake.create(spark, root)
    lake.store.write("_lock", "", exclusive=True)
    with pytest.raises(BlockingIOError):
        lake.remove(["src"])
    lake.store.delete("_lock")
    other = Lake(spark, root)
    other.remove(["src/docs/sub"])
    with pytest.raises(BlockingIOError):
        lake.remove(["src"])
    # An uncommitted generation is ignored, and removed by vacuum.
    os.makedirs(tmp_path / "lake/9/files")
    assert Lake(spark, root).generation == 3 and Lake(spark, root).vacuum() == ["9"]
    # A newest generation that can't be read is damage: readers fall back, writers refuse.
    for name in os.listdir(tmp_path / "lake/3/files"):
        os.remove(tmp_path / "lake/3/files" / name)
    hurt = Lake(spark, root)
    assert hurt.damage == {"lost": 3, "opened": 2} and hurt.files.count() == 2
    with pytest.raises(Damaged):
        hurt.remove(["src"])


def test_a_damaged_unit_costs_its_files_only(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    lake = Lake.create(spark, root, "fast", target=4096)
    lake.add(_entries(spark, ENTRIES[:3]))
    unit = lake.extents.where("path = 'src/docs/sub/b.txt'").first().unit
    hurt = lake.payloads.withColumn("data", F.when(F.col("unit") == unit, F.lit(b"no")).otherwise(F.col("data"))).collect()
    spark.createDataFrame([(r.unit, bytes(r.data)) for r in hurt], "unit long, data binary").write.mode("overwrite").parquet(f"{root}/2/payloads")
    totals, lost = lake.test()
    assert totals.first().ok == totals.first().units - 1 and [r.path for r in lost.collect()] == ["src/docs/sub/b.txt"]
    assert lake.contents().where("why is not null").count() == 1
    with pytest.raises(Damaged):
        lake.compact()


def test_extract_policies_and_scan(spark, root, tmp_path):
    lake = Lake(spark, root)
    out = tmp_path / "out"
    assert {r.outcome for r in extract(lake.contents(), str(out)).collect()} == {"written"}
    with pytest.raises(FileExistsError):
        extract(lake.contents(), str(out), "fail")
    assert {r.outcome for r in extract(lake.contents(), str(out), "skip").collect()} == {"skipped"}
    found = {r.path: bytes(r.content) for r in scan(spark, str(out)).where("not dir").collect()}
    assert {f"out/{k}": v for k, v in _contents(lake).items()} == found


def test_zip_archives(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", b"hello", "x.zip"), ("A.TXT", b"other", "x.zip"), ("sub/b.txt", b"world!!", "x.zip"), ("../up", b"no", "y.zip")], "path string, content binary, archive string")
    folder = f"file://{tmp_path}/zips"
    assert {r.archive: r.members for r in create_zips(rows, folder).collect()} == {"x.zip": 2, "y.zip": 1}
    (tmp_path / "zips/z.rar").write_bytes(b"Rar!\x1a\x07\x00rest")
    got = {(r.archive.rsplit("/", 1)[-1], r.path): r for r in read_archives(spark, folder).collect()}
    assert bytes(got["x.zip", "sub/b.txt"].content) == b"world!!" and got["y.zip", "../up"].content is None
    assert "RAR" in got["z.rar", ""].why


def test_stream_replays_do_nothing(spark, tmp_path):
    arriving, root = str(tmp_path / "arriving"), f"file://{tmp_path}/lake"
    _entries(spark, ENTRIES[:3]).repartition(1).write.parquet(arriving)
    Lake.create(spark, root, "fast", target=8192)
    ingest(files(spark, arriving), root, f"{tmp_path}/state").awaitTermination()
    lake = Lake(spark, root)
    assert lake.files.count() == 3 and lake.add(_entries(spark), batch=0)["files"] == 0
    _entries(spark, [("late.txt", b"late")]).repartition(1).write.mode("append").parquet(arriving)
    ingest(files(spark, arriving), root, f"{tmp_path}/state").awaitTermination()
    assert Lake(spark, root).files.count() == 4 and Lake(spark, root).generation == lake.generation + 1


def _bytes_under(root):
    return sum(os.path.getsize(os.path.join(folder, x)) for folder, _, names in os.walk(root.removeprefix("file://")) for x in names if "payloads" in folder)


def test_compaction_frees_bytes(spark, tmp_path):
    lake = Lake.create(spark, f"file://{tmp_path}/freed", "fast", target=65_536)
    kept = [(f"keep/{n}.bin", os.urandom(40_000)) for n in range(4)]
    lake.add(_entries(spark, [*kept, *((f"drop/{n}.bin", os.urandom(40_000)) for n in range(12))]))
    whole = _bytes_under(lake.root)
    lake.remove(["drop"])
    assert _bytes_under(lake.root) == whole
    before, after = lake.compact()
    assert after < before / 2 and _bytes_under(lake.root) < whole / 2
    again = Lake(spark, lake.root)
    assert again.damage is None and _contents(again) == dict(kept) and again.store.names("_commits") == [f"{again.generation}.json"]
    held = Lake.create(spark, f"file://{tmp_path}/held", "fast", target=65_536)
    held.add(_entries(spark, kept[:1]))
    held.compact(history=True)
    assert held.as_of(2)[0].count() == 1


def test_locks_end_with_their_owners(spark, tmp_path):
    import json
    import socket
    import subprocess
    import sys
    import time

    lake = Lake.create(spark, f"file://{tmp_path}/locked", "fast", target=65_536)
    ended = subprocess.Popen([sys.executable, "-c", ""])
    ended.wait()
    now = time.time()
    for held, free in (
        ({"owner": "x", "host": socket.gethostname(), "process": ended.pid, "time": now}, True),
        ({"owner": "x", "host": "elsewhere", "process": 1, "time": now}, False),
        ({"owner": "x", "host": "elsewhere", "process": 1, "time": now - 10**6}, True),
        ({"owner": "x", "host": socket.gethostname(), "process": os.getpid(), "time": now}, False),
    ):
        lake.store.write("_lock", json.dumps(held), exclusive=True)
        if free:
            with lake._writing():
                assert lake.lock()["process"] == os.getpid()
            assert lake.lock() is None
        else:
            with pytest.raises(BlockingIOError):
                lake.remove([])
            assert lake.lock() == held
            lake.store.delete("_lock")
    with pytest.raises(BlockingIOError), lake._writing():
        lake.store.delete("_lock")
        lake.store.write("_lock", json.dumps({"owner": "other"}), exclusive=True)
        lake._commit(lake.files, lake.units)
    assert lake.lock() == {"owner": "other"}


@pytest.mark.parametrize("version, words", [(99, "reads up to"), (0, "reads from")])
def test_other_formats_are_refused(spark, tmp_path, version, words):
    import json

    lake = Lake.create(spark, f"file://{tmp_path}/formats", "fast", target=65_536)
    marker = json.loads(lake.store.read("_commits/1.json")) | {"format": version, "generation": 2}
    lake.store.write("_commits/2.json", json.dumps(marker))
    with pytest.raises(Unreadable, match=words):
        Lake(spark, lake.root)


def test_times_attributes_and_folders_come_back(spark, tmp_path):
    from moraine.sources.archives import extract_folders

    lake = Lake.create(spark, f"file://{tmp_path}/timed", "fast", target=8192)
    rows = [("top/a.txt", b"words", 1_500_000_000, 250_000_000, 1, False), ("top/b.txt", b"", 0, 0, 0, False), ("top", None, 1_400_000_000, 0, 1, True), ("top/empty", None, 1_300_000_000, 0, 0, True), ("top/empty/deep", None, 0, 0, 0, True)]
    lake.add(spark.createDataFrame(rows, "path string, content binary, mtime long, mtime_nanos long, attrs long, dir boolean"))
    out = tmp_path / "out"
    assert [r.outcome for r in extract(lake.contents(), str(out)).collect()] == ["written"] * 2
    assert extract_folders(lake.folders(), str(out)) == 3
    held = os.stat(out / "top/a.txt")
    assert held.st_mtime_ns == 1_500_000_000_250_000_000 and not held.st_mode & 0o222 and os.stat(out / "top/b.txt").st_mode & 0o200
    assert (out / "top/empty/deep").is_dir() and os.stat(out / "top/empty").st_mtime == 1_300_000_000
    assert os.stat(out / "top").st_mtime == 1_400_000_000 and not os.stat(out / "top").st_mode & 0o222
    assert {r.outcome for r in extract(lake.contents(["top/a.txt"]), str(tmp_path / "one")).collect()} == {"written"}


def test_traces_progress_and_stranded_bytes(spark, tmp_path):
    lake = Lake.create(spark, f"file://{tmp_path}/traced", "normal", target=4096)
    seen = []
    copies = [*ENTRIES[:3], ("src/docs/again.txt", ENTRIES[0][1])]
    stats = lake.add(_entries(spark, copies), trace=True, progress=seen.append)
    assert [x["phase"] for x in seen] == ["scan", "work", "drain", "commit", "done"]
    assert seen[1]["files"] == 4 and seen[-1]["bytes_in"] == stats["bytes_in"] == sum(len(d) for _, d in copies)
    trace = lake.unit_trace().collect()
    assert sum(r.len for r in trace) == stats["bytes_in"] and sum(r.len for r in trace if r.deduped) == stats["bytes_deduped"] > 0
    assert {r.kind for r in trace} >= {"text", "store"} and all(r.items >= 1 and r.exts >= 1 for r in trace)
    raced = lake.tourney_trace().collect()
    units = {r.unit: r for r in lake.units.collect()}
    assert {r.unit for r in raced} == set(units) and all(r.unpacked == units[r.unit].unpacked and r.ms >= 0 for r in raced)
    # The winner of the race is what was kept.
    for unit, u in units.items():
        assert u.packed <= min(r.coded for r in raced if r.unit == unit)
    assert lake.stranded() == 0
    os.makedirs(tmp_path / "traced/7/payloads")
    (tmp_path / "traced/7/payloads/part").write_bytes(b"x" * 123)
    assert lake.stranded() == 123 and lake.vacuum() == ["7"] and lake.stranded() == 0


def test_listing_by_any_column(spark, root):
    from moraine.plans.lake import ordered

    listing = Lake(spark, root).listing()
    rows = listing.collect()
    for column in ("size", "stored", "path"):
        key = (lambda r: (r.path.lower(), r.path)) if column == "path" else (lambda r: getattr(r, column))  # noqa: B023
        for descending in (False, True):
            got = [key(r) for r in ordered(listing, column, descending).collect()]
            assert got == sorted(map(key, rows), reverse=descending)
