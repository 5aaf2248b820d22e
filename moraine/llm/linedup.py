r"""Line dedup as an exact set-similarity join.

A line is the set of its words.  Two lines match if the Jaccard similarity of
their sets is 0.8 or more, and a line is removed if it matches any earlier one, by
(id, text hash, line number), whether or not that one is itself removed.

* Words are counted over all documents, in two rows of `COUNTERS` counters that go to
  all tasks.  A word's count is the lesser of its two counters, never below the true
  one; words order by that count and hash.  Any one order gives the same matches.
* Lines of equal sets become one class, numbered in the order of first occurrences.
* Classes meet where the prefix of one (n - ceil(0.8 n) + 1 rarest words) shares a
  word with the shorter prefix (n - ceil(8/9 n) + 1) of one of as many words or fewer,
  and have to pass the length filter, the positional filter and a bitmap filter
  (128 parity bits bound the overlap from above); no filter can lose a match.
* At words in the shorter prefixes of more than `CROWD` classes all are first held
  against the earliest of those.
  Those that this removes only take part as earlier classes of the others from then
  on, so a crowd of variants of one line never meets pair by pair.
* Candidates are verified on the words themselves.

Words are split, hashed and ordered in Arrow batches, and everything that joins or
groups is a DataFrame operation: the form in DataFrame functions alone took more
than twice the processor time that this operator is given (see the README).

Defined results: lines without words are never removed nor counted as matches; a
null text has no lines; rows are told apart by id and text, so null and repeated
ids are judged by their own lines, ranked by a hash of their texts, and rows equal
in both are one document; a null id ranks last; an empty table gives an empty
table; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST, drop_folder, keyed, scratch, settled
from .hashing import hashes_of, mix, parts

COUNTERS, CROWD = 1 << 19, 128
#: So many counters go from task to task as one row.
BLOCK = 1 << 10
#: So many wanted lines (of 28 bytes) are sent to all tasks at most; beyond that texts are dealt out to meet them.
BROADCAST_LINES = 150_000
#: Slices of text that are held at once: the arrays of its lines' sets take many times a text, those of a count fewer.
_COUNTED, _SLICED = ({"most_bytes": n << 20, "most_rows": 20_000} for n in (4, 1))
_PLACE = ("id", "row", "nth")
#: Of a prefix, the n - ceil(8/9 n) + 1 rarest words.  A match of two lines shares one of them, of the line of fewer words, with the other's prefix.
_INDEXED = "9 * at <= n"


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The number of lines of each text, the distinct words of all, and each word's line and place among the distinct."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    words = pc.ascii_split_whitespace(lines.flatten())
    line = np.repeat(np.arange(len(words)), np.diff(np.asarray(words.offsets)))
    coded = words.flatten().dictionary_encode()
    some = np.asarray(pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False), bool)
    at = np.asarray(coded.indices)
    kept = some[at] if len(some) else np.empty(0, bool)
    return np.diff(np.asarray(lines.offsets)), coded.dictionary, line[kept], at[kept]


def _counters(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counters of words, by their hashes, in each of the two rows."""
    last = np.uint64(COUNTERS - 1)
    return (value & last).astype(np.int64), ((value >> np.uint64(32)) & last).astype(np.int64)


def _blocks(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["block", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counters, once, in blocks: those of the second row follow those of the first."""
    total = np.zeros((2, COUNTERS), np.int64)
    for batch in parts(batches, "text", **_COUNTED):
        _, words, _, at = _split(batch.column("text"))
        n = np.bincount(at, minlength=len(words))
        for row, counter in zip(total, _counters(hashes_of(words))):
            np.add.at(row, counter, n)
    yield from _blocks({block: n for block, n in enumerate(total.reshape(-1, BLOCK)) if n.any()})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the blocks of all tasks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, n in zip(batch.column("block").to_pylist(), batch.column("n")):
            total[block] = total.get(block, 0) + np.frombuffer(n.as_buffer(), np.int64)
    yield from _blocks(total)


def word_counters(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both rows of counters of the words of all texts."""
    kind = "block int, n binary"
    table = texts.select("text").mapInArrow(_count, kind).repartition("block").mapInArrow(_summed, kind).toArrow()
    total = np.zeros((2 * COUNTERS // BLOCK, BLOCK), np.int64)
    for block, n in zip(table["block"].to_pylist(), table["n"]):
        total[block] = np.frombuffer(n.as_buffer(), np.int64)
    one, two = total.reshape(2, COUNTERS)
    return one, two


def line_sets(texts: pa.Array, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """The text and number of each line with words, and (d1, d2, n, b1, b2, prefix) of its set; `one` and `two` are rows of counters or empty."""
    lines, words, line, at = _split(texts)
    value = hashes_of(words)
    if len(one):
        first, second = _counters(value)
        often = np.minimum(one[first], two[second])
    else:
        often = np.zeros(len(value), np.int64)
    # One key of 24 bits of the count and 40 of the hash, which is all that `prefix` holds: words of equal keys are one word there.
    order = np.argsort((np.minimum(often, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
    rarity = np.empty(len(value), np.uint64)
    rarity[order] = np.arange(len(value), dtype=np.uint64)
    key = (line.astype(np.uint64) << np.uint64(32)) | rarity[at]
    key.sort()  # np.unique hashes integers, which takes twenty times as long
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    key = key[new]
    owner, word = (key >> np.uint64(32)).astype(np.int64), value[order][(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    n = np.diff(np.append(start, len(owner)))
    prefix = n - (4 * n + 4) // 5 + 1
    held = np.arange(len(owner)) - np.repeat(start, n) < np.repeat(prefix, n)
    bit, high = np.uint64(1) << (word & np.uint64(63)), (word & np.uint64(64)) != 0
    total = (lambda f, x: f.reduceat(x, start)) if len(start) else (lambda f, x: x)
    with np.errstate(over="ignore"):
        columns = [total(np.add, mix(word)), total(np.add, mix(word ^ np.uint64(0x632BE59BD9B4E019))), n.astype(np.int32), total(np.bitwise_xor, np.where(high, np.uint64(0), bit)), total(np.bitwise_xor, np.where(high, bit, np.uint64(0)))]
    ends = np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((word[held] >> np.uint64(24)).view(np.int64)))
    first = np.cumsum(lines) - lines
    text = np.repeat(np.arange(len(lines)), lines)[owner[start]]
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns]
    return text, owner[start] - first[text], pa.RecordBatch.from_arrays([*arrays, lists], ["d1", "d2", "n", "b1", "b2", "prefix"])


def _lines(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", **_SLICED):
            text, nth, sets = line_sets(batch.column("text"), *held.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(text)) for c in ("id", "row")), pa.array(nth.astype(np.int32)), *sets.columns], [*_PLACE, *sets.schema.names])

    return lines


def _reach(x: str, y: str) -> Column:
    """Length, positional and bitmap filters of two members: an overlap o needs 9 o >= 4 (nx + ny), and 2 o <= nx + ny - apart."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = F.bit_count(F.col(f"{x}.b1").bitwiseXOR(F.col(f"{y}.b1"))) + F.bit_count(F.col(f"{x}.b2").bitwiseXOR(F.col(f"{y}.b2")))
    return (F.least(nx, ny) * 5 >= F.greatest(nx, ny) * 4) & (apart * 9 <= nx + ny) & (F.least(nx - F.col(f"{x}.at"), ny - F.col(f"{y}.at")) * 9 >= (nx + ny) * 4)


def _words(docs: DataFrame, classes: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    """(c, words) of the classes that stand in `pairs`: the words of their first occurrences."""
    wanted = pairs.select(F.col("x").alias("c")).union(pairs.select("y")).distinct()
    wanted = settled(classes.join(wanted, "c").select("c", *_PLACE), f"{folder}-wanted")
    small = wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    places = wanted.groupBy("id", "row").agg(F.collect_list(F.struct("nth", "c")).alias("places"))
    texts = docs.join(F.broadcast(places) if small else places, ["id", "row"]).select(F.split("text", "\n").alias("lines"), F.explode("places").alias("place"))
    words = texts.select("place.c", F.array_distinct(F.array_remove(F.split(F.translate(F.get("lines", F.col("place.nth")), "\t\x0b\x0c\r", "    "), " "), "")).alias("words"))
    return settled(words.dropDuplicates(["c"]), f"{folder}-text")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    """(c): the classes x of (x, y) that match their y."""
    if pairs.isEmpty():
        return pairs.select(F.col("x").alias("c"))
    words = _words(docs, classes, pairs, folder)
    both = pairs.join(words.toDF("x", "xs"), "x").join(words.toDF("y", "ys"), "y")
    return both.where(F.size(F.array_intersect("xs", "ys")) * 9 >= (F.size("xs") + F.size("ys")) * 4).select(F.col("x").alias("c")).distinct()


def _matched(docs: DataFrame, classes: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """(c): the classes that match an earlier class; `sets` has their n, bitmaps and prefixes."""
    spark = docs.sparkSession
    members = sets.select("c", "n", "b1", "b2", F.posexplode("prefix").alias("at", "word"))
    crowds = settled(members.where(_INDEXED).groupBy("word").agg(F.count(F.lit(1)).alias("classes"), F.min("c").alias("c")).where(F.col("classes") > CROWD).select("word", "c"), f"{folder}/crowds")
    heads = settled(members.join(crowds, ["word", "c"]), f"{folder}/heads")
    small = heads.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    led = members.alias("x").join((F.broadcast(heads) if small else heads).alias("y"), (F.col("x.word") == F.col("y.word")) & (F.col("y.c") < F.col("x.c")) & _reach("x", "y"))
    led = settled(led.select(F.col("x.c").alias("x"), F.col("y.c").alias("y")).distinct(), f"{folder}/led")
    done = settled(_verified(docs, classes, led, f"{folder}/led"), f"{folder}/done")
    drop_folder(spark, *(f"{folder}/{x}" for x in ("crowds", "heads", "led", "led-wanted", "led-text")))
    flagged = sets.join(done.withColumn("done", F.lit(1)), "c", "left").select("c", "n", "b1", "b2", F.coalesce("done", F.lit(0)).alias("done"), F.posexplode("prefix").alias("at", "word"))
    shorter = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.c") < F.col("x.c")))
    # The later class has to be open.  What holds for `y` alone is tested together with `x`, so that both sides stay one plan and share one shuffle.
    open_ = F.when(F.col("y.c") < F.col("x.c"), F.col("x.done")).otherwise(F.col("y.done")) == 0
    indexed = F.col("y.at") * 9 + F.least(F.col("x.n"), F.lit(0)) <= F.col("y.n")
    met = flagged.alias("x").join(flagged.alias("y"), (F.col("x.word") == F.col("y.word")) & indexed & shorter & open_ & _reach("x", "y"))
    pairs = settled(met.select(F.greatest("x.c", "y.c").alias("x"), F.least("x.c", "y.c").alias("y")).distinct(), f"{folder}/pairs")
    matched = settled(_verified(docs, classes, pairs, f"{folder}/pairs").union(done), f"{folder}/matched")
    drop_folder(spark, *(f"{folder}/{x}" for x in ("done", "pairs", "pairs-wanted", "pairs-text")))
    return matched


def removed_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, removed): the numbers of the lines to remove from each document, by `keyed`, that loses one."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    texts = keyed(docs, doc, text)
    held = spark.sparkContext.broadcast(word_counters(texts))
    lines = settled(texts.where("text is not null").mapInArrow(_lines(held), "id long, row long, nth int, d1 long, d2 long, n int, b1 long, b2 long, prefix array<long>"), f"{folder}/lines")
    place = F.struct(*_PLACE)
    firsts = settled(lines.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")), f"{folder}/firsts")
    # Numbers rise from range to range and within each, so they order classes as their first occurrences do.
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = firsts.repartitionByRange(ranges, "first").sortWithinPartitions("first").select("d1", "d2", "first.*", (F.col("last") > F.col("first")).alias("several"), F.monotonically_increasing_id().alias("c"))
    classes = settled(ordered, f"{folder}/classes")
    drop_folder(spark, f"{folder}/firsts")
    # Rows equal in id and text have lines of equal places, of which one goes on; the join keeps to that partitioning.
    sets = settled(lines.drop("d1", "d2").dropDuplicates([*_PLACE]).join(classes.select("c", *_PLACE), [*_PLACE]).select("c", "n", "b1", "b2", "prefix"), f"{folder}/sets")
    placed = settled(lines.select(*_PLACE, "d1", "d2"), f"{folder}/placed")
    drop_folder(spark, f"{folder}/lines")
    matched = _matched(texts, classes, sets, folder)
    drop_folder(spark, f"{folder}/sets")
    gone = classes.join(matched.withColumn("gone", F.lit(True)), "c", "left").where("several or gone").select("d1", "d2", F.struct(*_PLACE).alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"))
    out = placed.join(gone, ["d1", "d2"]).where(F.col("gone") | (place != F.col("first"))).groupBy("id", "row").agg(F.sort_array(F.collect_set("nth")).alias("removed"))
    out = settled(out, f"{folder}/removed")
    drop_folder(spark, *(f"{folder}/{x}" for x in ("placed", "classes", "matched")))
    return out


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per row of `docs`: (doc, n_lines, n_removed, removed) and the text without the removed lines."""
    gone = removed_lines(docs, doc, text)
    held = F.coalesce(F.col(text), F.lit(""))
    lines = (F.octet_length(held) - F.octet_length(F.replace(held, F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(doc).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("row"), lines.alias("n_lines"), *([F.col(text).alias("text")] if keep_text else []))
    rows = rows.join(gone, ["id", "row"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    out = [F.col("doc").alias(doc), F.col("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.col("removed")]
    if keep_text:
        out.append(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("removed"), i)), "\n").alias("text"))
    return rows.select(*out)


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs, keep_text=False)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS nth, list_sort(list_distinct(regexp_extract_all(all_lines[i], '[^\x20\x09-\x0D]+'))) AS s
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
  WHERE len(regexp_extract_all(all_lines[i], '[^\x20\x09-\x0D]+')) > 0),
u AS (SELECT s, len(s) AS n, min((doc_id, nth)) AS first FROM l GROUP BY s),
w AS (SELECT first, n, unnest(s) AS word FROM u),
df AS (SELECT word, count(*) AS df FROM w GROUP BY word),
r AS (SELECT first, n, w.word, row_number() OVER (PARTITION BY first ORDER BY df, w.word) AS rk FROM w JOIN df USING (word)),
p AS (SELECT * FROM r WHERE rk <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT x.first AS xf, y.first AS yf FROM p x JOIN p y ON x.word = y.word AND y.first < x.first AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
m AS (
  SELECT DISTINCT xf FROM c JOIN u x ON x.first = xf JOIN u y ON y.first = yf
  WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)),
g AS (
  SELECT l.doc_id, l.nth FROM l JOIN u USING (s) LEFT JOIN m ON m.xf = u.first
  WHERE m.xf IS NOT NULL OR (l.doc_id, l.nth) <> u.first),
t AS (SELECT doc_id, count(*) AS n_removed, list(nth::INT ORDER BY nth) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, []::INT[]) AS removed
FROM documents d LEFT JOIN t USING (doc_id)
"""
