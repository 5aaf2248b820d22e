"""Paths, selectors, sizes: worked examples."""

from pyspark.sql import functions as F

from moraine import functions as L
from moraine.operators.chunking import cuts, fold
from moraine.plans.queries import kept_candidates, selected, smallest, winners


def _map(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(x,) for x in values], f"x {kind}").select("x", column(F.col("x")).alias("y")).collect()
    return {r.x: r.y for r in rows}


def test_group_key(spark):
    got = _map(spark, ["a/b.RS", "d.v1/f", ".gitignore", "noext", "x.", "a.tar.gz", "a.abcdefghijklmnopqrst"], L.group_key)
    assert list(got.values()) == ["rs", "", "gitignore", "", "", "gz", ""]


def test_selectors(spark):
    entries = spark.createDataFrame([("src/docs",), ("src/docs/a.txt",), ("src/docs2/a.txt",)], "path string")
    got = {r.path for r in selected(entries, spark.createDataFrame([("src\\docs\\",)], "sel string")).collect()}
    assert got == {"src/docs", "src/docs/a.txt"}


def test_paths(spark):
    got = _map(spark, ["a/b", "../a", "a/..", "con", "x/NUL.tar", "conx", "a:b", "a ", "", "ok.txt"], L.path_ok)
    assert [k for k, v in got.items() if v] == ["a/b", "conx", "ok.txt"]
    assert list(_map(spark, ["./a/b", "a\\b", ".", "a/../b"], L.normalize_rel).values()) == ["a/b", "a/b", None, None]


def test_sizes(spark):
    assert list(_map(spark, [0, 1023, 1024, 3328, 1 << 40], L.human, "long").values()) == ["0 B", "1023 B", "1.0 KiB", "3.2 KiB", "1.0 TiB"]
    assert list(_map(spark, ["10", "4K", " 2m ", "1G", "x"], L.parse_size).values()) == [10, 4096, 2 << 20, 1 << 30, None]


def test_stored_bytes(spark):
    rows = spark.createDataFrame([(100, 30, 10), (100, 30, 20), (100, 30, 30), (7, 0, 0)], "p long, u long, n long")
    assert [r.x for r in rows.select(L.stored_bytes(F.col("p"), F.col("u"), F.col("n")).alias("x")).collect()] == [33, 66, 100, 7]


def test_race_rules(spark):
    rows = [(0, 0, 2, 0, 115, 9), (0, 1, 3, 10, 102, 8), (0, 2, 3, 16, 101, 8), (0, 3, 4, 0, 100, 8), (1, 0, 2, 0, 116, 5), (1, 1, 3, 10, 103, 5), (1, 2, 3, 16, 103, 4), (1, 3, 4, 0, 100, 6)]
    race = spark.createDataFrame(rows, "unit int, place int, codec int, param int, sample int, coded int")
    kept = {(r.unit, r.codec, r.param) for r in kept_candidates(race).collect()}
    assert kept == {(0, 2, 0), (0, 3, 16), (0, 4, 0), (1, 4, 0)}
    assert {(r.unit, r.codec) for r in winners(kept_candidates(race)).collect()} == {(0, 3), (1, 4)}


def test_keep_smallest(spark):
    rows = spark.createDataFrame([(1, 100, 90, 80), (2, 100, 100, 120), (3, 100, 80, 100)], "unit int, unpacked long, coded long, filtered long")
    assert [(r.form, r.packed, r.filtered) for r in smallest(rows).orderBy("unit").collect()] == [("filtered", 80, 80), ("original", 100, 0), ("coded", 80, 0)]


def _item(path, n, digest="ff" * 32, kind="text", size=None, alone=False):
    return (path, n, size or n, digest, kind, alone)


def test_fold_rules():
    never = "ff" * 8 + "00" * 24  # its number modulo 8 is 7
    assert fold([_item("a", 3, never), _item("b", 3, never), _item("c", 1, never)], 8) == [(0, 0, "end"), (0, 3, "end"), (0, 6, "end")]
    cut = "00" * 32
    assert fold([_item("a", 3, never), _item("b", 3, cut), _item("c", 1, never)], 8) == [(0, 0, "hash"), (0, 3, "hash"), (1, 0, "end")]
    assert [x[0] for x in fold([_item("a", 10, never), _item("b", 7, never)], 8)][:2] == [0, 1]
    assert [x[0] for x in fold([_item("a", 1, never, size=5000), _item("b", 1, never, kind="binary", size=5000)], 8)] == [0, 1]
    assert [x[0] for x in fold([_item("a", 1, never), _item("b", 1, never, alone=True), _item("b", 1, never, alone=True), _item("c", 1, never)], 8)] == [0, 1, 1, 2]


def test_cuts_are_local_and_bounded():
    import random

    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    one = cuts(data, 256, 1024, 4096)
    sizes = [b - a for a, b in zip([0, *one], one)]
    assert one[-1] == len(data) and max(sizes) <= 4096 and min(sizes[:-1]) >= 256
    two = cuts(data[:30_000] + b"edit" + data[30_000:], 256, 1024, 4096)
    shared = {x for x in one if x < 29_000} & set(two), {x + 4 for x in one if x > 36_000} & set(two)
    assert len(shared[0]) == sum(x < 29_000 for x in one) and len(shared[1]) >= 0.9 * sum(x > 36_000 for x in one)
    assert cuts(b"", 1, 2, 3) == []


def test_long_recordings_are_cut_between_frames():
    import struct

    from moraine.operators.chunking import wav_runs

    head = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"data" + struct.pack("<I", 40_000)
    data = head + bytes(40_000) + b"the tail"
    ends = wav_runs(data, 8192)
    assert ends[-1] == len(data) and all((x - len(head)) % 4 == 0 for x in ends[:-1])
    assert all(b - a <= 8192 for a, b in zip([0, *ends], ends))
    assert wav_runs(data, 16) is None and wav_runs(b"RIFF", 8192) is None


def test_registered_functions(spark):
    from moraine.functions.register import register

    assert "cdc_chunks" in register(spark)
    row = spark.sql("SELECT group_key('a/b.RS') AS k, selector_matches('src/docs/a', 'src\\\\docs/') AS m, stored_bytes(100, 30, 10) AS s, byte_entropy(X'0001') AS e, content_kind(X'504B0304') AS c").first()
    assert tuple(row) == ("rs", True, 33, 1.0, "container")
    assert spark.sql("SELECT sum(length) AS n FROM cdc_chunks(unhex(repeat('00112233', 5000)), 256, 1024, 4096)").first().n == 20_000


def test_registered_paths_and_kinds(spark):
    from moraine.functions.register import register

    assert {"path_ok", "sniff", "zip_entries"} <= set(register(spark))
    names = ["a/b.txt", "a//b", "../x", "a\\b", "con", "x/nul.txt", "end.", "end ", 'q"q', "tab\tx", "fine name.bin", "a:b", ".", "", None]
    table = spark.createDataFrame([(x,) for x in names], "path string")
    table.createOrReplaceTempView("some_names")
    both = spark.sql("SELECT path, path_ok(path) AS ok FROM some_names").select("ok", L.path_ok(F.col("path")).alias("want")).collect()
    assert [r.ok for r in both] == [r.want for r in both] and sum(bool(r.ok) for r in both) == 2
    heads = spark.createDataFrame([(bytearray(bytes.fromhex(digits) + b"rest of it"),) for digits, _ in L.MAGIC] + [(bytearray(b"RIFF0000WAVEfmt "),), (bytearray(b"text"),), (bytearray(),), (None,)], "data binary")
    heads.createOrReplaceTempView("some_heads")
    kinds = [tuple(r) for r in spark.sql("SELECT data, sniff(data) AS kind FROM some_heads").select("kind", L.sniff(F.col("data"))).collect()]
    assert all(a == b for a, b in kinds) and [a for a, _ in kinds][-4:-1] == ["wav", "other", "other"]
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("a/b.txt", "words " * 50)
        out.writestr("c", "")
    found = spark.sql(f"SELECT * FROM zip_entries(X'{held.getvalue().hex()}')").collect()
    assert [(r.nth, r.path, r.size) for r in found] == [(0, "a/b.txt", 300), (1, "c", 0)]
    assert spark.sql("SELECT * FROM zip_entries(X'00')").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from moraine.__main__ import run

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("some text " * 500)
    (tmp_path / "in/sub/b.txt").write_text("other text")
    lake, source = f"file://{tmp_path}/lake", f"file://{tmp_path}/in"
    assert run(spark, ["create", lake, source, "--level", "fast"]) == 0
    assert run(spark, ["mv", lake, "in/sub", "in/below"]) == 0 and run(spark, ["l", lake]) == 0 and run(spark, ["t", lake]) == 0 and run(spark, ["info", lake, "--units"]) == 0
    assert run(spark, ["x", lake, f"{tmp_path}/out", "in/below"]) == 0
    assert (tmp_path / "out/in/below/b.txt").read_text() == "other text"
    assert run(spark, ["create", f"file://{tmp_path}/z.zip", source]) == 0 and run(spark, ["list", f"file://{tmp_path}/z.zip"]) == 0
    assert "in/below/b.txt" in capsys.readouterr().out
    assert run(spark, ["-j", "4", "list", lake, "--sort", "size", "--descending"]) == 0
    shown = capsys.readouterr().out
    assert shown.index("in/a.txt") < shown.index("in/below/b.txt")


def test_parts_of_paths_and_times(spark):
    rows = [("a/b.c/d.Txt", 0, 0.4), ("x\\y.tar.GZ", 1_700_000_000, 59.5), ("/root", None, 3599.0), ("plain", 60, 3600.0), (".hid", -14_182_980, 90_061.0), (None, 1, -5.0)]
    table = spark.createDataFrame(rows, "p string, t long, d double")
    got = [tuple(r) for r in table.select(L.parent_of(F.col("p")), L.strip_ext(F.col("p")), L.icon_kind(F.col("p")), L.when_text(F.col("t")), L.hhmmss(F.col("d"))).collect()]
    s, m, h = "\u0441", "\u043c\u0438\u043d", "\u0447"
    assert got == [
        ("a/b.c", "a/b.c/d", "doc", "\u2014", f"0 {s}"), ("x", "x\\y.tar", "archive", "14.11.2023 22:13", f"1 {m} 00 {s}"), ("/root", "/root", "generic", "\u2014", f"59 {m} 59 {s}"),
        ("plain", "plain", "generic", "01.01.1970 00:01", f"1 {h} 00 {m}"), (".hid", "", "generic", "20.07.1969 20:17", f"25 {h} 01 {m}"), (None, None, None, "01.01.1970 00:00", f"0 {s}"),
    ]
