r"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of ten consecutive words (an item of fewer, but not
none, is one window).  An exact window needs all of its words, so with words
ordered by rarity over all documents its necessary prefix is its rarest word:
only document words equal to some window's rarest word are joined.  A candidate
then has to pass the length and positional bounds (the window must fit around
the matched word) and is verified word by word against the slice of the document
it would cover.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased.
Defined results: null and wordless texts have no words and are never hit; equal
windows of several items are joined once and then fan out to all of them; an
empty benchmark leaves every document clean; rows are told apart by id and text,
so null and repeated ids are judged by their own text and repeated rows each get
their row; an empty table gives an empty table; columns other than id and text are
not read, and `keep_clean` passes all columns on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, settled

BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, in texts without and with A-Z.
BETWEEN = r"[^a-z0-9\x80-\x{10FFFF}]+"
BETWEEN_ANY_CASE = r"[^A-Za-z0-9\x80-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most so many windows are broadcast (about 500 bytes each); beyond that the join is by shuffle.
BROADCAST_WINDOWS = 100_000
#: Bits of the table that rules words out before a shuffle: half a megabyte, however many windows there are.
FILTER_BITS = 1 << 22


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def bench_words(text: Column) -> Column:
    """The contract's words, exactly: only A-Z are lower-cased."""
    return _split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER))


def folded(text: Column) -> Column:
    """Every letter lower-cased, whatever stands around it: the one lower case that depends on neighbours, a final sigma, is undone."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def folded_words(text: Column) -> Column:
    """The same words folded, which is far cheaper and keeps their number and places.

    Equal exact words are equal here too, so this serves to find candidates;
    what it finds in a text with characters beyond ASCII is then verified with
    `bench_words`.
    """
    return _split(folded(F.coalesce(text, F.lit(""))))


def row_key(doc: str, text: str) -> Column:
    """Tells rows apart by id and text, so null or repeated ids do no harm."""
    return F.concat_ws(":", F.coalesce(F.col(doc).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text), F.lit(""))))


def windows_of(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(window array<string>, item): one row for each distinct pair."""
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
    return (
        benchmark.select(F.col(item).alias("item"), bench_words(F.col(text)).alias("w"))
        .where(F.size(w) > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice(w, i + 1, F.lit(size)))).alias("window"))
        .distinct()
    )


def hits_of(docs: DataFrame, doc: str, text: str, windows: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(key, start, window): each occurrence of a distinct window in a document, `key` being its `row_key`."""
    spark = docs.sparkSession
    distinct = windows.select("window").distinct()
    small = distinct.limit(broadcast_windows + 1).count() <= broadcast_windows
    held = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    fold = F.transform("window", folded)
    texts = docs.select(row_key(doc, text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    vocabulary = distinct.select(F.explode(fold).alias("word")).distinct()
    frequency = texts.select(F.explode(folded_words(F.col("text"))).alias("word")).join(held(vocabulary), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # The rarest word of each window and where it first stands in it; a window with a word that no document has can't occur.
    anchors = (
        distinct.select("window", F.posexplode(fold).alias("at", "word"))
        .join(frequency, "word", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("at"), F.col("word"))).alias("anchor"))
        .where("anchor.df > 0")
        .select("window", fold.alias("folded"), F.size("window").alias("k"), F.col("anchor.word").alias("word"), F.col("anchor.at").alias("at"))
    )
    fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("k") <= F.size("w"))
    start = F.col("pos") - F.col("at")
    if small:
        # Nothing but generated code stands between the explode and the last filter, so a
        # long text's rows are made and dropped one by one, never held together.
        plain = F.octet_length("text") == F.length("text")
        exact = plain | (F.slice(bench_words(F.col("text")), start + 1, F.col("k")) == F.col("window"))
        found = texts.withColumn("w", folded_words(F.col("text"))).select("key", "text", "w", F.posexplode("w").alias("pos", "word"))
        return found.join(F.broadcast(anchors), "word").where(fits & (F.slice("w", start + 1, F.col("k")) == F.col("folded")) & exact).select("key", start.alias("start"), "window")
    # By shuffle, a word takes only the words around it along, and only if a table of `FILTER_BITS` bits, of which all
    # windows' rarest words set theirs, doesn't rule it out.
    reach = F.lit(anchors.agg(F.max("k")).first()[0] or 1)
    cell = lambda word: F.pmod(F.xxhash64(word), F.lit(FILTER_BITS // 64)).cast("int")
    bit = lambda word: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(F.xxhash64(word), 40), F.lit(64)).cast("int"))
    bits = anchors.groupBy(cell("word").alias("cell")).agg(F.bit_or(bit("word")).alias("bits"))
    every = spark.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("cell")).join(bits, "cell", "left")
    every = settled(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bits")), f"{scratch(spark)}/bits")
    found = texts.withColumn("w", bench_words(F.col("text"))).select("key", "w", F.posexplode("w").alias("pos", "exact"))
    found = found.where(F.get(every.scalar(), cell(folded(F.col("exact")))).bitwiseAND(bit(folded(F.col("exact")))) != 0)
    found = found.select("key", folded(F.col("exact")).alias("word"), "pos", F.slice("w", F.greatest(F.col("pos") - reach + 2, F.lit(1)), reach * 2 - 1).alias("near"), F.least(F.col("pos"), reach - 1).alias("left"))
    begins = F.col("left") - F.col("at")
    met = found.join(anchors, "word").where((begins >= 0) & (begins + F.col("k") <= F.size("near"))).where(F.slice("near", begins + 1, F.col("k")) == F.col("window"))
    return met.select("key", start.alias("start"), "window")


def flag(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: (doc, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = windows_of(benchmark, item, item_text, size)
    hits = hits_of(docs, doc, text, windows, broadcast_windows)
    hits = settled(hits, f"{scratch(docs.sparkSession)}/hits")  # read twice below
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["start"] + x["k"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["start"] + x["k"]).alias("end")),
    )["n"]
    n_hit = hits.groupBy("key").agg(F.collect_set(F.struct("start", F.size("window").alias("k"))).alias("spans")).select("key", covered.cast("long").alias("n_hit"))
    items = (
        hits.select("key", "window").distinct().join(windows, "window").select("key", F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item")).distinct()
        .groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    sizes = docs.select(F.col(doc).alias("doc"), row_key(doc, text).alias("key"), F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN_ANY_CASE), "")).cast("long").alias("n_words"))
    held = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return sizes.join(n_hit.join(items, "key"), "key", "left").select(
        F.col("doc").alias(doc),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(held).cast("long").alias("n_items"),
        F.sha2(F.array_join(held, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that share no window with the benchmark, with the columns of `docs`."""
    hit = hits_of(docs, doc, text, windows_of(benchmark, "item_id", "text", 10)).select("key").distinct()
    named = docs.select("*", row_key(doc, text).alias("__row_key"))
    return named.join(hit, named["__row_key"] == hit["key"], "left_anti").select(*[F.col(c) for c in docs.columns])


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return flag(docs, benchmark)


ORACLE = rf"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{BENCH_WORD}') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{BENCH_WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[p : p + 9], ' ') AS win, least(10, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
spans AS (
  SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM lowered, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, p, spans.k, item_id FROM spans JOIN windows ON spans.win = windows.win AND spans.k = windows.k),
per_doc AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
per_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT l.doc_id, len(l.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(per_item.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN per_doc USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""
