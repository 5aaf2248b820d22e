"""The lake's catalogue questions as plans, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as L
from ..operators.codecs import entropy, stride
from ..operators.ordering import running, upper_median
from ..sources.virtual import EXTENTS, LIVE, TREE, UNITS, extents, kept, read, tree, units
from ..store import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_GKEY = "CASE WHEN instr(path, '.') > 0 AND strlen(regexp_extract(path, '[^.]*$')) BETWEEN 1 AND 16 AND instr(regexp_extract(path, '[^.]*$'), '/') = 0 THEN lower(regexp_extract(path, '[^.]*$')) ELSE '' END"
_SELECTORS = [("src0",), ("src1\\en\\",), ("conv/1",), ("bench/item_3.txt",), ("src/nope",), ("page",)]
_SELECTORS_SQL = "sel AS (SELECT rtrim(replace(s, chr(92), '/'), '/') AS sel FROM (VALUES ('src0'), ('src1' || chr(92) || 'en' || chr(92)), ('conv/1'), ('bench/item_3.txt'), ('src/nope'), ('page')) v(s))"


@query("tree_entries", f"WITH {TREE} SELECT path, size, {_GKEY} AS gkey, len(string_split(path, '/'))::BIGINT AS depth FROM tree")
def tree_entries(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).select("path", "size", L.group_key(F.col("path")).alias("gkey"), F.size(F.split("path", "/")).cast("long").alias("depth"))


def selected(entries: DataFrame, selectors: DataFrame) -> DataFrame:
    """(sel, path): entries that equal a selector or lie below it; an equi-join with each entry's ancestors."""
    named = entries.select("path", F.explode(L.ancestors(F.col("path"))).alias("sel"))
    return named.join(selectors.select(L.normalize_selector(F.col("sel")).alias("sel")).distinct(), "sel").select("sel", "path")


@query("select_prefix", f"WITH {TREE}, {_SELECTORS_SQL} SELECT sel, path FROM tree JOIN sel ON path = sel OR starts_with(path, sel || '/')")
def select_prefix(spark, d):
    return selected(tree(spark, d), spark.createDataFrame(_SELECTORS, "sel string"))


@query("selector_misses", f"WITH {TREE}, {_SELECTORS_SQL} SELECT sel FROM sel WHERE NOT EXISTS (SELECT 1 FROM tree WHERE path = sel OR starts_with(path, sel || '/'))")
def selector_misses(spark, d):
    selectors = spark.createDataFrame(_SELECTORS, "sel string").select(L.normalize_selector(F.col("sel")).alias("sel"))
    return selectors.join(select_prefix(spark, d), "sel", "left_anti")


@query("filter_substring", f"WITH {TREE} SELECT path, substr(path, 6) AS shown FROM tree WHERE starts_with(path, 'src1/') AND contains(lower(path), 'doc_1')")
def filter_substring(spark, d):
    found = tree(spark, d).where(F.col("path").startswith("src1/") & F.lower("path").contains(F.lower(F.trim(F.lit(" DOC_1 ")))))
    return found.select("path", F.substring("path", 6, 1 << 20).alias("shown"))


@query("group_key_counts", f"WITH {TREE} SELECT {_GKEY} AS gkey, count(*) AS files, sum(size)::BIGINT AS bytes FROM tree GROUP BY 1")
def group_key_counts(spark, d):
    return tree(spark, d).groupBy(L.group_key(F.col("path")).alias("gkey")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


_PATHS = ["a", "a/b.txt", "dir/file name", "x.tar.gz", "con", "dir/NUL.txt", "com1.log", "console.txt", "a/../b", "./a", "a//b", "/abs", "a\\b", "c:evil", "tab\tx", "end.", "end ", "q?", "st*r", "pi|pe", "lt<", "ünïcode/ok", "lpt9", "lpt", "", "aux.tar.gz"]
_PATHS_SQL = "p AS (SELECT unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in _PATHS) + "]) AS path)"
_DEVICES_SQL = ", ".join(f"'{x}'" for x in L.DEVICES)


@query(
    "path_safety",
    f"WITH {_PATHS_SQL} SELECT path, len(list_filter(string_split(path, '/'), lambda c: c = '' OR c = '.' OR c = '..' OR regexp_matches(c, '[\\\\:<>\"|?*\\x00-\\x1f]') OR regexp_matches(c, '[ .]$') OR lower(regexp_extract(c, '^[^.]*')) IN ({_DEVICES_SQL}))) = 0 AS ok FROM p",
)
def path_safety(spark, d):
    return spark.createDataFrame([(x,) for x in _PATHS], "path string").select("path", L.path_ok(F.col("path")).alias("ok"))


@query(
    "case_collisions",
    f"WITH {TREE}, e AS (SELECT path, 0 AS batch FROM tree UNION ALL SELECT upper(path), 1 FROM tree WHERE starts_with(path, 'bench/')) "
    "SELECT path, first AS claimed_by FROM (SELECT path, first_value(path) OVER (PARTITION BY lower(path) ORDER BY batch, path) AS first FROM e) WHERE path <> first",
)
def case_collisions(spark, d):
    entries = tree(spark, d).select("path", F.lit(0).alias("batch"))
    entries = entries.union(entries.where(F.col("path").startswith("bench/")).select(F.upper("path"), F.lit(1)))
    claims = entries.groupBy(L.collision_key(F.col("path")).alias("key")).agg(F.min(F.struct("batch", "path"))["path"].alias("claimed_by"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return entries.withColumn("key", L.collision_key(F.col("path"))).join(claims, "key").where("path <> claimed_by").select("path", "claimed_by")


@query("folder_rollup", f"WITH {TREE}, a AS (SELECT string_split(path, '/') AS p, size FROM tree), f AS (SELECT array_to_string(p[1:i], '/') AS folder, size FROM (SELECT p, size, unnest(range(1, len(p))) AS i FROM a)) SELECT folder, count(*) AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY folder")
def folder_rollup(spark, d):
    above = F.slice(L.ancestors(F.col("path")), F.lit(1), F.size(F.split("path", "/")) - 1)
    return tree(spark, d).select(F.explode(above).alias("folder"), "size").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def work_list(spark, d, **sums):
    keyed = tree(spark, d).withColumn("gkey", L.group_key(F.col("path")))
    return running(keyed, ["gkey", "path"], scratch(spark), sums=sums)


@query("work_order", f"WITH {TREE}, k AS (SELECT *, {_GKEY} AS gkey FROM tree) SELECT path, gkey, row_number() OVER (ORDER BY gkey, path) - 1 AS seq, coalesce(sum(size) OVER (ORDER BY gkey, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k")
def work_order(spark, d):
    return work_list(spark, d, start="size").select("path", "gkey", "seq", "start")


_FOLDERS = "f AS (SELECT DISTINCT array_to_string(list_slice(p, 1, i), '/') AS path, i AS depth FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM tree)))"


@query("folders_deepest", f"WITH {TREE}, {_FOLDERS} SELECT path, depth::INT AS depth, row_number() OVER (ORDER BY depth DESC, path) - 1 AS place FROM f")
def folders_deepest(spark, d):
    """Folders in the order in which their times and attributes come back: the deepest first."""
    above = F.explode(F.slice(L.ancestors(F.col("path")), F.lit(1), L.depth(F.col("path")) - 1)).alias("path")
    folders = tree(spark, d).select(above).distinct().withColumn("up", -L.depth(F.col("path")))
    return running(folders, ["up", "path"], scratch(spark), number="place").select("path", (-F.col("up")).alias("depth"), "place")


@query("entries_by_size", f"WITH {TREE} SELECT path, size, row_number() OVER (ORDER BY size DESC, path) - 1 AS place FROM tree")
def entries_by_size(spark, d):
    """Entries as a listing by size, the largest first, has them."""
    rows = tree(spark, d).select("path", "size", (-F.col("size")).alias("less"))
    return running(rows, ["less", "path"], scratch(spark), number="place").select("path", "size", "place")


@query("content_hash", f"WITH {TREE} SELECT path, hash FROM tree")
def content_hash(spark, d):
    return tree(spark, d).select("path", "hash")


@query("dedup_groups", f"WITH {TREE} SELECT hash, count(*) AS copies, min(size) AS size, min(path) AS first_path FROM tree GROUP BY hash HAVING count(*) > 1")
def dedup_groups(spark, d):
    return tree(spark, d).groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"), F.min("path").alias("first_path")).where("copies > 1")


@query("dedup_savings", f"WITH {TREE}, g AS (SELECT hash, count(*) AS n, min(size) AS size FROM tree GROUP BY hash) SELECT sum(n)::BIGINT AS files, sum(n * size)::BIGINT AS bytes_in, sum(size)::BIGINT AS bytes_stored, sum((n - 1) * size)::BIGINT AS bytes_deduped, round(100.0 * sum(size) / sum(n * size), 6)::DOUBLE AS ratio FROM g")
def dedup_savings(spark, d):
    groups = tree(spark, d).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    total = groups.agg(F.sum("n").alias("files"), F.sum(F.col("n") * F.col("size")).alias("bytes_in"), F.sum("size").alias("bytes_stored"), F.sum((F.col("n") - 1) * F.col("size")).alias("bytes_deduped"))
    return total.select("*", F.round(F.when(F.col("bytes_in") > 0, F.col("bytes_stored") * 100.0 / F.col("bytes_in")), 6).alias("ratio"))


@query("first_copy", f"WITH {TREE}, k AS (SELECT *, {_GKEY} AS gkey FROM tree) SELECT path, first_value(path) OVER w AS first_path, row_number() OVER w = 1 AS stored FROM k WINDOW w AS (PARTITION BY hash ORDER BY gkey, path)")
def first_copy(spark, d):
    keyed = tree(spark, d).withColumn("gkey", L.group_key(F.col("path")))
    first = keyed.groupBy("hash").agg(F.min(F.struct("gkey", "path"))["path"].alias("first_path"))
    return keyed.join(first, "hash").select("path", "first_path", (F.col("path") == F.col("first_path")).alias("stored"))


@query("extent_offsets", f"WITH {EXTENTS} SELECT path, pos, unit, len, coalesce(sum(len) OVER (PARTITION BY unit ORDER BY path, pos, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM extents")
def extent_offsets(spark, d):
    inside = Window.partitionBy("unit").orderBy("path", "pos", "len").rowsBetween(Window.unboundedPreceding, -1)  # a unit is at most 64 MiB
    return extents(spark, d).withColumn("off", F.coalesce(F.sum("len").over(inside), F.lit(0)).cast("long"))


@query("unit_fixed_pack", f"WITH {TREE}, k AS (SELECT *, {_GKEY} AS gkey FROM tree WHERE size > 0), s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY gkey, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k), e AS (SELECT path, size, start, unnest(range(start // 65536, (start + size - 1) // 65536 + 1)) AS unit FROM s) SELECT unit::BIGINT AS unit, count(*) AS pieces, sum(least(start + size, (unit + 1) * 65536) - greatest(start, unit * 65536))::BIGINT AS bytes FROM e GROUP BY unit")
def unit_fixed_pack(spark, d, target: int = 65536):
    placed = work_list(spark, d, start="size").where("size > 0")
    first, last = F.floor(F.col("start") / target), F.floor((F.col("start") + F.col("size") - 1) / target)
    pieces = placed.select("start", "size", F.explode(F.sequence(first, last)).alias("unit"))
    held = F.least(F.col("start") + F.col("size"), (F.col("unit") + 1) * target) - F.greatest(F.col("start"), F.col("unit") * target)
    return pieces.groupBy("unit").agg(F.count(F.lit(1)).alias("pieces"), F.sum(held).alias("bytes"))


_STORED = "CASE WHEN unpacked = 0 OR len >= unpacked THEN packed ELSE (packed * len) // unpacked END"


@query("stored_size", f"WITH {UNITS} SELECT path, sum(len)::BIGINT AS size, sum({_STORED})::BIGINT AS stored FROM extents JOIN units USING (unit) GROUP BY path")
def stored_size(spark, d):
    joined = extents(spark, d).join(units(spark, d), "unit")
    return joined.groupBy("path").agg(F.sum("len").alias("size"), F.sum(L.stored_bytes(F.col("packed"), F.col("unpacked"), F.col("len"))).alias("stored"))


@query("list_totals", f"WITH {UNITS}, f AS (SELECT path, sum(len) AS size, sum({_STORED}) AS stored FROM extents JOIN units USING (unit) GROUP BY path) SELECT count(*) AS files, sum(size)::BIGINT AS size, sum(stored)::BIGINT AS stored FROM f")
def list_totals(spark, d):
    return stored_size(spark, d).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.sum("stored").alias("stored"))


@query("entry_solid", f"WITH {UNITS}, f AS (SELECT path, count(*) AS n, sum(len) AS size, min(unpacked) AS unpacked FROM extents JOIN units USING (unit) GROUP BY path) SELECT path, size::BIGINT AS size, CASE WHEN n = 1 THEN unpacked <> size ELSE true END AS solid FROM f")
def entry_solid(spark, d):
    per_file = extents(spark, d).join(units(spark, d), "unit").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("size"), F.min("unpacked").alias("unpacked"))
    return per_file.select("path", "size", F.when(F.col("n") == 1, F.col("unpacked") != F.col("size")).otherwise(True).alias("solid"))


def live(spark, d):
    return units(spark, d).join(kept(spark, d), "unit", "left_semi")


@query("live_units", f"WITH {LIVE} SELECT unit, packed, unpacked FROM live")
def live_units(spark, d):
    return live(spark, d).select("unit", "packed", "unpacked")


@query("dead_units", f"WITH {LIVE} SELECT unit, packed FROM units WHERE unit NOT IN (SELECT unit FROM live)")
def dead_units(spark, d):
    return units(spark, d).join(kept(spark, d), "unit", "left_anti").select("unit", "packed")


@query("info_summary", f"WITH {LIVE} SELECT (SELECT count(DISTINCT path) FROM extents) AS files, (SELECT count(*) FROM units) AS units, (SELECT sum(packed) FROM units)::BIGINT AS file_len, (SELECT sum(packed) FROM live)::BIGINT AS live_bytes, greatest(0, (SELECT sum(packed) FROM units) - (SELECT sum(packed) FROM live) - 196)::BIGINT AS reclaimable")
def info_summary(spark, d):
    flagged = units(spark, d).join(kept(spark, d).withColumn("live", F.lit(True)), "unit", "left")
    sums = flagged.agg(F.count(F.lit(1)).alias("units"), F.sum("packed").alias("file_len"), F.sum(F.when(F.col("live"), F.col("packed"))).alias("live_bytes"))
    files = extents(spark, d).agg(F.count_distinct("path").alias("files")).scalar()
    return sums.select(files.alias("files"), "units", "file_len", "live_bytes", F.greatest(F.lit(0), F.col("file_len") - F.col("live_bytes") - (16 + 100 + 80)).cast("long").alias("reclaimable"))


@query("bytes_by_codec", f"WITH {LIVE} SELECT codec, sum(packed)::BIGINT AS bytes, count(*) AS units FROM live GROUP BY codec")
def bytes_by_codec(spark, d):
    return live(spark, d).groupBy("codec").agg(F.sum("packed").alias("bytes"), F.count(F.lit(1)).alias("units"))


@query("unit_sizes", f"WITH {LIVE}, s AS (SELECT list_sort(list(unpacked)) AS s FROM live) SELECT coalesce(s[1], 0) AS smallest, coalesce(s[len(s) // 2 + 1], 0) AS median, coalesce(s[len(s)], 0) AS largest FROM s")
def unit_sizes(spark, d):
    known = live(spark, d)
    zero = F.lit(0).cast("long")
    return known.agg(F.coalesce(F.min("unpacked"), zero).alias("smallest"), F.coalesce(F.max("unpacked"), zero).alias("largest")).select("smallest", upper_median(known, "unpacked").alias("median"), "largest")


_MEMBERS = f"""{TREE}, k AS (SELECT *, {_GKEY} AS gkey FROM tree WHERE size > 0), s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k),
m AS (SELECT path, gkey, size, unnest(range(start // 65536, (start + size - 1) // 65536 + 1))::BIGINT AS unit, start FROM s)"""


def members(spark, d, target: int = 65536):
    """(unit, path, gkey, len): pieces of files, placed by path in units of fixed size."""
    placed = running(tree(spark, d).where("size > 0").withColumn("gkey", L.group_key(F.col("path"))), ["path"], scratch(spark), sums={"start": "size"})
    pieces = placed.select("path", "gkey", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / target), F.floor((F.col("start") + F.col("size") - 1) / target))).alias("unit"))
    return pieces.select("unit", "path", "gkey", (F.least(F.col("start") + F.col("size"), (F.col("unit") + 1) * target) - F.greatest("start", F.col("unit") * target)).alias("len"))


@query(
    "unit_report",
    f"WITH {_MEMBERS}, c AS (SELECT unit, gkey, count(DISTINCT path) AS n FROM m GROUP BY unit, gkey), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, gkey) AS place FROM c) "
    "SELECT unit, sum(n)::BIGINT AS files, count(*) AS exts, max(CASE WHEN place = 1 THEN CASE WHEN gkey = '' THEN '-' ELSE gkey END END) AS top_ext FROM r GROUP BY unit",
)
def unit_report(spark, d):
    counts = members(spark, d).select("unit", "gkey", "path").distinct().groupBy("unit", "gkey").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("gkey").alias("gkey")))["gkey"]
    return counts.groupBy("unit").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("exts"), F.when(best == "", "-").otherwise(best).alias("top_ext"))


@query(
    "ext_top4",
    f"WITH {_MEMBERS}, c AS (SELECT unit, gkey, count(*) AS n FROM m GROUP BY unit, gkey), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, gkey) AS place FROM c) "
    "SELECT unit, count(*) AS exts, string_agg(gkey || ':' || n, ' ' ORDER BY place) FILTER (WHERE place <= 4) AS top FROM r GROUP BY unit",
)
def ext_top4(spark, d):
    counts = members(spark, d).groupBy("unit", "gkey").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.groupBy("unit").agg(F.count(F.lit(1)).alias("exts"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("gkey")))), 1, 4).alias("top"))
    return ranked.select("unit", "exts", F.array_join(F.transform("top", lambda x: F.concat_ws(":", x["gkey"], (-x["m"]).cast("string"))), " ").alias("top"))


@query(
    "unit_vote",
    f"WITH {UNITS}, v AS (SELECT unit, (pos % 3)::INT AS codec, (len % 2)::INT AS filter, sum(len)::BIGINT AS bytes FROM extents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY bytes DESC, codec, filter) AS place FROM v) SELECT unit, codec, filter, bytes FROM r WHERE place = 1",
)
def unit_vote(spark, d):
    votes = extents(spark, d).groupBy("unit", F.pmod("pos", F.lit(3)).cast("int").alias("codec"), F.pmod("len", F.lit(2)).cast("int").alias("filter")).agg(F.sum("len").alias("bytes"))
    best = F.min(F.struct((-F.col("bytes")).alias("less"), "codec", "filter")).alias("best")
    return votes.groupBy("unit").agg(best).select("unit", "best.codec", "best.filter", (-F.col("best.less")).alias("bytes"))


@query("rename_prefix", f"WITH {TREE} SELECT path, CASE WHEN path = 'src3' OR starts_with(path, 'src3/') THEN 'moved/three' || substr(path, 5) ELSE path END AS renamed FROM tree")
def rename_prefix(spark, d):
    path = F.col("path")
    hit = (path == "src3") | path.startswith("src3/")
    return tree(spark, d).select("path", F.when(hit, F.concat(F.lit("moved/three"), F.substring(path, 5, 1 << 20))).otherwise(path).alias("renamed"))


@query("rename_conflicts", f"WITH {TREE}, r AS (SELECT path, 'CONV/2' || substr(path, 7) AS target FROM tree WHERE starts_with(path, 'conv/1/')) SELECT r.path, target FROM r WHERE lower(target) IN (SELECT lower(path) FROM tree WHERE NOT starts_with(path, 'conv/1/'))")
def rename_conflicts(spark, d):
    """Entries of conv/1 that a move to CONV/2 would put where conv/2 has one already."""
    entries, inside = tree(spark, d), F.col("path").startswith("conv/1/")
    moved = entries.where(inside).select("path", F.concat(F.lit("CONV/2"), F.substring("path", 7, 1 << 20)).alias("target")).withColumn("key", F.lower("target"))
    still = entries.where(~inside).select(F.lower("path").alias("key"))
    return moved.join(still, "key", "left_semi").select("path", "target")


@query("path_parts", f"WITH {TREE} SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_replace(path, '\\.[^.]*$', '') AS stem, CASE WHEN ends_with(path, '.html') THEN 'code' ELSE 'doc' END AS kind FROM tree")
def path_parts(spark, d):
    """Each path's folder, the path without its extension, and the kind of file."""
    return tree(spark, d).select("path", L.parent_of(F.col("path")).alias("parent"), L.strip_ext(F.col("path")).alias("stem"), L.icon_kind(F.col("path")).alias("kind"))


@query("decode_cost", f"WITH {LIVE} SELECT bool_or(codec BETWEEN 2 AND 4) AS slow, bool_or(codec = 4) AS hungry FROM live")
def decode_cost(spark, d):
    """Whether some live unit is slow to decode, and whether some takes much memory."""
    return live(spark, d).agg(F.bool_or(F.col("codec").between(2, 4)).alias("slow"), F.bool_or(F.col("codec") == 4).alias("hungry"))


@query("remove_prefix", f"WITH {TREE} SELECT path FROM tree WHERE NOT (path = 'conv/1' OR starts_with(path, 'conv/1/') OR path = 'src5' OR starts_with(path, 'src5/'))")
def remove_prefix(spark, d):
    entries = tree(spark, d).select("path")
    gone = selected(entries, spark.createDataFrame([("conv/1",), ("src5/",)], "sel string")).select("path")
    return entries.join(gone, "path", "left_anti")


@query("compact_remap", f"WITH {UNITS}, f AS (SELECT unit, min(struct_pack(path := path, pos := pos)) AS first FROM extents GROUP BY unit) SELECT unit AS old_unit, row_number() OVER (ORDER BY first, unit) - 1 AS new_unit FROM f")
def compact_remap(spark, d):
    first = extents(spark, d).groupBy("unit").agg(F.min(F.struct("path", "pos")).alias("first")).select("unit", "first.path", "first.pos")
    return running(first, ["path", "pos", "unit"], scratch(spark), number="new_unit").select(F.col("unit").alias("old_unit"), "new_unit")


_LOG = "log AS (SELECT 'users/' || user_id || '.log' AS path, ts, event_id, event_type, value, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS generation FROM events)"


def log(spark, d):
    return read(spark, d, "events").select(F.concat(F.lit("users/"), "user_id", F.lit(".log")).alias("path"), "ts", "event_id", "event_type", "value", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("generation"))


def latest(rows: DataFrame) -> DataFrame:
    """The last write of each path, by (ts, event_id); partial maxima go into the shuffle."""
    last = rows.groupBy("path").agg(F.max(F.struct("ts", "event_id", "event_type", "generation")).alias("last"), F.count(F.lit(1)).alias("writes"))
    return last.select("path", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"), F.col("last.generation").alias("generation"), "writes")


@query("upsert_latest", f"WITH {_LOG} SELECT path, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(generation, (ts, event_id)) AS generation, count(*) AS writes FROM log GROUP BY path")
def upsert_latest(spark, d):
    return latest(log(spark, d))


@query("generation_asof", f"WITH {_LOG}, g AS (SELECT *, (min(generation) OVER () + max(generation) OVER ()) // 2 AS half FROM log) SELECT path, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(generation, (ts, event_id)) AS generation, count(*) AS writes FROM g WHERE generation <= half GROUP BY path")
def generation_asof(spark, d):
    rows = log(spark, d)
    half = rows.agg(F.floor((F.min("generation") + F.max("generation")) / 2).alias("half")).scalar()
    return latest(rows.where(F.col("generation") <= half))


@query("damage_report", f"WITH {LIVE} SELECT count(*) AS units, count(*) FILTER (WHERE unit % 97 <> 0) AS ok, coalesce(sum(unpacked) FILTER (WHERE unit % 97 <> 0), 0)::BIGINT AS bytes_ok, coalesce(string_agg(unit, ',' ORDER BY unit) FILTER (WHERE unit % 97 = 0), '') AS bad FROM live")
def damage_report(spark, d):
    bad = F.col("unit") % 97 == 0
    return live(spark, d).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(~bad).alias("ok"), F.coalesce(F.sum(F.when(~bad, F.col("unpacked"))), F.lit(0)).alias("bytes_ok"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(bad, F.col("unit")))), lambda x: x.cast("string")), ",").alias("bad"),
    )


@query("damaged_files", f"WITH {UNITS} SELECT DISTINCT path FROM extents WHERE unit % 97 = 0 OR unit NOT IN (SELECT unit FROM units)")
def damaged_files(spark, d):
    joined = extents(spark, d).join(units(spark, d).select(F.col("unit").alias("known")), F.col("unit") == F.col("known"), "left")
    return joined.where((F.col("unit") % 97 == 0) | F.col("known").isNull()).select("path").distinct()


@query("delta_column", "SELECT l_orderkey, l_linenumber, ((l_partkey % 256 - coalesce(lag(l_partkey % 256, 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 0) + 256) % 256)::BIGINT AS delta FROM lineitem")
def delta_column(spark, d):
    byte = F.pmod("l_partkey", F.lit(256))
    before = F.lag(byte, 2, 0).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod(byte - before + 256, F.lit(256)).alias("delta"))


@query("spread_sample", "SELECT doc_id, md5(concat(" + ", ".join(f"substr(hex(encode(text)), 2 * ((strlen(text) // 8) * {i}) + 1, 2 * (strlen(text) // 128))" for i in range(8)) + ")) AS sample FROM documents")
def spread_sample(spark, d):
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return read(spark, d, "documents").select("doc_id", F.md5(F.hex(L.spread_sample(data, F.octet_length(data))).cast("binary")).alias("sample"))


_RACE = [(0, 0, 2, 0, 115, 9000), (0, 1, 3, 10, 102, 8000), (0, 2, 3, 16, 101, 8100), (0, 3, 4, 0, 100, 8000), (1, 0, 2, 0, 116, 50), (1, 1, 3, 10, 103, 50), (1, 2, 3, 16, 103, 49), (1, 3, 4, 0, 100, 60), (2, 0, 2, 0, 90, 7), (2, 1, 3, 10, 95, 7), (2, 2, 3, 16, 95, 6), (2, 3, 4, 0, 110, 9)]
_RACE_SQL = "race AS (SELECT * FROM (VALUES " + ", ".join(map(str, _RACE)) + ") v(unit, place, codec, param, sample, coded))"


def kept_candidates(race: DataFrame) -> DataFrame:
    """The qualifier: block sorting always; the better order of the other model within 2 %; the rest within 15 %."""
    of_unit = Window.partitionBy("unit")
    best = F.min("sample").over(of_unit)
    better = F.min(F.when(F.col("codec") == 3, F.struct("sample", "place"))).over(of_unit)
    keep = (F.col("codec") == 4) | ((F.col("codec") == 3) & (F.col("place") == better["place"]) & (F.col("sample") * 100 <= best * 102)) | (~F.col("codec").isin(3, 4) & (F.col("sample") * 100 <= best * 115))
    return race.withColumn("keep", keep).where("keep").drop("keep")


_KEEP_SQL = _RACE_SQL + ", b AS (SELECT *, min(sample) OVER (PARTITION BY unit) AS best, min(CASE WHEN codec = 3 THEN struct_pack(s := sample, p := place) END) OVER (PARTITION BY unit) AS better FROM race), kept AS (SELECT unit, place, codec, param, sample, coded FROM b WHERE codec = 4 OR (codec = 3 AND place = better.p AND sample * 100 <= best * 102) OR (codec NOT IN (3, 4) AND sample * 100 <= best * 115))"


def _race(spark):
    return spark.createDataFrame(_RACE, "unit int, place int, codec int, param int, sample int, coded int")


@query("qualify_prune", f"WITH {_KEEP_SQL} SELECT unit, place, codec, param FROM kept")
def qualify_prune(spark, d):
    return kept_candidates(_race(spark)).select("unit", "place", "codec", "param")


def winners(race: DataFrame) -> DataFrame:
    best = race.groupBy("unit").agg(F.min(F.struct("coded", "place", "codec", "param")).alias("best"))
    return best.select("unit", "best.codec", "best.param", "best.coded")


@query("race_winner", f"WITH {_KEEP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY coded, place) AS n FROM kept) SELECT unit, codec, param, coded FROM r WHERE n = 1")
def race_winner(spark, d):
    return winners(kept_candidates(_race(spark)))


@query("keep_smallest", "WITH u AS (SELECT p_partkey AS unit, (p_size * 7) % 101 + 20 AS unpacked, (p_size * 13) % 101 + 10 AS coded, (p_size * 29) % 101 + 10 AS filtered FROM part) SELECT unit, CASE WHEN least(coded, filtered) >= unpacked THEN unpacked WHEN filtered < coded THEN filtered ELSE coded END::BIGINT AS packed, CASE WHEN least(coded, filtered) >= unpacked THEN 'original' WHEN filtered < coded THEN 'filtered' ELSE 'coded' END AS form, CASE WHEN least(coded, filtered) >= unpacked OR filtered = unpacked THEN 0 ELSE filtered END::BIGINT AS filtered FROM u")
def keep_smallest(spark, d):
    size = F.col("p_size").cast("long")
    sized = read(spark, d, "part").select(F.col("p_partkey").alias("unit"), (size * 7 % 101 + 20).alias("unpacked"), (size * 13 % 101 + 10).alias("coded"), (size * 29 % 101 + 10).alias("filtered"))
    return smallest(sized).select("unit", "packed", "form", "filtered")


def smallest(sized: DataFrame) -> DataFrame:
    """Original unless something is smaller; filtered bytes as they are only if strictly smaller than coded ones."""
    plain = F.least("coded", "filtered") >= F.col("unpacked")
    raw = F.col("filtered") < F.col("coded")
    form = F.when(plain, "original").when(raw, "filtered").otherwise("coded")
    packed = F.when(plain, F.col("unpacked")).when(raw, F.col("filtered")).otherwise(F.col("coded"))
    return sized.withColumn("form", form).withColumn("packed", packed).withColumn("filtered", F.when(plain | (F.col("filtered") == F.col("unpacked")), F.lit(0)).otherwise(F.col("filtered")).cast("long"))


@query("progress_curve", "WITH e AS (SELECT o_orderpriority AS run, o_orderkey AS seq, floor(o_totalprice % 1000)::BIGINT AS done FROM orders), m AS (SELECT run, seq, max(done) OVER (PARTITION BY run ORDER BY seq) AS peak, max(done) OVER (PARTITION BY run) AS total FROM e) SELECT run, seq, least(peak, total - 1) AS shown FROM m")
def progress_curve(spark, d):
    events = read(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("seq"), F.expr("cast(floor(o_totalprice % 1000) as bigint)").alias("done"))
    run = Window.partitionBy("run")
    peak = F.max("done").over(run.orderBy("seq"))
    return events.select("run", "seq", F.least(peak, F.max("done").over(run) - 1).alias("shown"))


_MAGIC = ["504B0304140000000800", "377ABCAF271C0004", "526172211A0700CF", "526172211A070100", "526172211A0702", "89504E470D0A1A0A00", "1F8B08", "255044462D", "FFD8FFE0", "524946460000000057415645666D7420", "52494646000000004156492066", "494433030000", "4D5A90", "7F454C4602", "28B52FFD04", "FD377A585A0000", "", "68656C6C6F"]


@query(
    "magic_sniff",
    "WITH m AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _MAGIC) + "]) AS head) SELECT head, CASE WHEN starts_with(head, '504B0304') THEN 'zip' WHEN starts_with(head, '377ABCAF271C') THEN '7z' WHEN starts_with(head, '526172211A0700') OR starts_with(head, '526172211A070100') THEN 'rar' WHEN starts_with(head, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(head, '1F8B') THEN 'gzip' WHEN starts_with(head, '25504446') THEN 'pdf' WHEN starts_with(head, 'FFD8FF') THEN 'jpeg' WHEN starts_with(head, '52494646') AND substr(head, 17, 8) = '57415645' THEN 'wav' WHEN starts_with(head, '494433') THEN 'mp3' WHEN starts_with(head, '4D5A') OR starts_with(head, '7F454C46') THEN 'executable' WHEN starts_with(head, '28B52FFD') THEN 'zstd' WHEN starts_with(head, 'FD377A585A00') THEN 'xz' ELSE 'other' END AS kind FROM m",
)
def magic_sniff(spark, d):
    return spark.createDataFrame([(x,) for x in _MAGIC], "head string").select("head", L.sniff(F.unhex("head")).alias("kind"))


@query("human_sizes", f"WITH {TREE} SELECT path, CASE WHEN size >= 1048576 THEN printf('%.1f MiB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1f KiB', size / 1024.0) ELSE size || ' B' END AS shown FROM tree")
def human_sizes(spark, d):
    return tree(spark, d).select("path", L.human(F.col("size")).alias("shown"))


@query("attribute_mask", "SELECT o_orderkey, (o_custkey & 8199)::BIGINT AS attrs, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE epoch(o_orderdate)::BIGINT END AS mtime FROM orders")
def attribute_mask(spark, d):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").bitwiseAND(0x2007).alias("attrs"), F.when(F.col("o_custkey") % 3 != 0, seconds).alias("mtime"))


def _entropies(distance: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = [x or b"" for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([round(entropy(x, distance), 6) if len(x) > distance else None for x in data], pa.float64())], ["doc_id", "bits"])

    return run


def _documents_data(spark, d):
    return read(spark, d, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


_BYTES = "b AS (SELECT doc_id, ('0x' || substr(h, 2 * i - 1, 2))::INT AS x, i FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, unnest(range(1, strlen(coalesce(text, '')) + 1)) AS i FROM documents))"


@query("byte_entropy", f"WITH {_BYTES}, c AS (SELECT doc_id, x, count(*) AS n FROM b GROUP BY doc_id, x), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c), e AS (SELECT doc_id, round(abs(sum(n / total * log2(n / total))), 6) AS bits FROM t GROUP BY doc_id) SELECT d.doc_id, e.bits FROM documents d LEFT JOIN e USING (doc_id)")
def byte_entropy(spark, d):
    """Bytes are counted in their row, as vectors; nothing is shuffled."""
    return _documents_data(spark, d).mapInArrow(_entropies(0), "doc_id long, bits double")


@query("delta_entropy", f"WITH {_BYTES}, l AS (SELECT doc_id, (x - lag(x) OVER (PARTITION BY doc_id ORDER BY i) + 256) % 256 AS x FROM b), c AS (SELECT doc_id, x, count(*) AS n FROM l WHERE x IS NOT NULL GROUP BY doc_id, x), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c), e AS (SELECT doc_id, round(abs(sum(n / total * log2(n / total))), 6) AS bits FROM t GROUP BY doc_id) SELECT d.doc_id, e.bits FROM documents d LEFT JOIN e USING (doc_id)")
def delta_entropy(spark, d):
    return _documents_data(spark, d).mapInArrow(_entropies(1), "doc_id long, bits double")


@query("best_stride")
def best_stride(spark, d):
    """The record width of each embedding stored as float32, and of each document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([stride(x or b"") for x in batch.column("data").to_pylist()], pa.int32())], ["doc_id", "stride"])

    return _documents_data(spark, d).mapInArrow(run, "doc_id long, stride int")


@query("cdc_chunks")
def cdc_chunks(spark, d):
    """(path, nth, len, digest, kind): content-defined chunks of every file."""
    from .. import model as M
    from ..operators.chunking import items

    return items(tree(spark, d, content=True), M.geometry("fast", 65536)).select("path", "nth", "len", "digest", "kind")


@query("unit_assembly")
def unit_assembly(spark, d):
    """(group, deal, local, items, bytes, cut): units assembled from the chunks."""
    from .. import model as M
    from ..operators.chunking import assemble, items

    shape = M.geometry("fast", 65536)
    placed = assemble(items(tree(spark, d, content=True), shape).drop("content"), shape["target"])
    return placed.groupBy("group", "deal", "local").agg(F.count(F.lit(1)).alias("items"), F.sum("len").alias("bytes"), F.max("cut").alias("cut"))


@query("codec_race")
def codec_race(spark, d):
    """The winning codec of every distinct content, raced one codec a row."""
    from ..operators.codecs import race

    distinct = tree(spark, d, content=True).groupBy("hash").agg(F.first("content").alias("data")).select(F.xxhash64("hash").alias("unit"), "data")
    return race(distinct)


def _lake(spark, d, root):
    from .lake import Lake

    lake = Lake.create(spark, root, "fast", target=1 << 20)
    lake.add(tree(spark, d, content=True).select("path", "content"))
    return lake


@query("lake_listing", f"WITH {TREE} SELECT path, size, false AS dir, CASE WHEN size = 0 THEN false END AS empty_solid FROM tree")
def lake_listing(spark, d):
    """A lake made of the whole tree, listed; stored sizes depend on codecs, and an empty file is in no shared unit."""
    return _lake(spark, d, scratch(spark)).listing().select("path", "size", "dir", F.when(F.col("size") == 0, F.col("solid")).alias("empty_solid"))


@query("verify_all", f"WITH {TREE} SELECT path, size AS bytes_ok, 0::BIGINT AS bytes_lost FROM tree WHERE size > 0")
def verify_all(spark, d):
    """A lake made of the whole tree, each unit opened and checked: the bytes of each file in units that verify."""
    lake = _lake(spark, d, scratch(spark))
    met = lake.extents.join(lake.verdicts().select("unit", "why"), "unit", "left")
    return met.groupBy("path").agg(F.sum(F.when(F.col("why").isNull(), F.col("len")).otherwise(0)).alias("bytes_ok"), F.sum(F.when(F.col("why").isNull(), 0).otherwise(F.col("len"))).alias("bytes_lost"))


@query("extract_all", f"WITH {TREE} SELECT path, size, hash, NULL::VARCHAR AS why FROM tree")
def extract_all(spark, d):
    """A lake made of the whole tree, read back whole."""
    got = _lake(spark, d, scratch(spark)).contents()
    return got.select("path", "size", F.substring(F.sha2("content", 256), 1, 32).alias("hash"), "why")


@query("zip_round_trip", f"WITH {TREE} SELECT path, size, hash FROM tree")
def zip_round_trip(spark, d):
    """The whole tree written as zip archives and read back."""
    from ..sources.archives import create_zips, read_archives
    from ..store import settled

    root = scratch(spark)
    entries = tree(spark, d, content=True).withColumn("archive", F.concat(F.lit("part-"), F.pmod(F.xxhash64("path"), F.lit(16)), F.lit(".zip")))
    settled(create_zips(entries, f"{root}/zips"), f"{root}/index")
    return read_archives(spark, f"{root}/zips").select("path", "size", F.substring(F.sha2("content", 256), 1, 32).alias("hash"))


@query("stream_ingest", f"WITH {TREE} SELECT path, size FROM tree")
def stream_ingest(spark, d):
    """The tree arriving as a stream of files, each batch a generation of a lake."""
    from ..streaming.ingest import files, ingest
    from .lake import Lake

    root = scratch(spark)
    tree(spark, d, content=True).select("path", "content").repartition(2).write.parquet(f"{root}/arriving")
    Lake.create(spark, f"{root}/lake", "fast", target=1 << 20)
    query_ = ingest(files(spark, f"{root}/arriving", per_batch=1), f"{root}/lake", f"{root}/state")
    query_.awaitTermination()
    return Lake(spark, f"{root}/lake").files.select("path", "size")
