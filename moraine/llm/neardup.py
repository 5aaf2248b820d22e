"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the multiset of its five-word shingles.  Each shingle, with its
count as weight, owns the region [0, weight) x [0, inf) of a weight-rank plane in
which a hash of the shingle throws darts, one per unit of area on average.  Every
dart has a rank and is dealt to one of `ROWS * BANDS` coordinates; a coordinate
keeps the earliest.  Documents share a coordinate with the probability of their
weighted Jaccard similarity.  Ranks come in layers of one unit: a document throws
about k ln k + 2k darts in all, or one for each shingle if it has more.

Texts of equal words form one class first, so copies cost one row each.  Class
representatives that agree on a whole band meet in a bucket; each is compared with
the bucket's hub by exact similarity.  Members without a link to the hub are then
held against all members of their bucket, in blocks of bounded size of which only
connecting links leave a task.  So two candidates are either linked through their
hub or compared with each other: no link between candidates is lost, and no pairs
within a group are emitted.

Defined results: texts are classed, not ids, and a class is named by its smallest
id.  A null, empty or blank text has no shingles, is a class of its own, named by
its own id, and always stays; a text of fewer than five words has one shingle, of
all of them; rows with equal ids and different texts are judged by their texts; of
rows equal in id and text `keep_one` leaves one; a null id ranks last, and a class
of null ids only has a null name and keeps one row; columns other than id and text
are passed on, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, drop_folder, keyed, scratch, settled
from .graph import components
from .hashing import MAX, WordHashes, mix, parts, payloads, shingles, units

#: Two texts at the limit itself share a band but for a chance of (1 - 0.8 ** 6) ** 30, one in ten thousand.
ROWS, BANDS, WIDTH, SIMILARITY = 6, 30, 5, 0.8
#: Poisson(1): the chance of at most n darts in a unit of area.
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, n + 1))) for n in range(12)])


def _darts(doc: np.ndarray, seed: np.ndarray, first: np.ndarray, count: np.ndarray, k: int, signature: np.ndarray) -> None:
    """Throws the darts of unit regions `seed` with ranks from `first` for `count` units; keeps the earliest in `signature`."""
    row = np.repeat(np.arange(len(doc)), count)
    rank = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    with np.errstate(over="ignore"):
        cell = mix(seed[row] + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        thrown = np.searchsorted(_POISSON, (cell >> np.uint64(11)) * (1.0 / (1 << 53)), side="right")
        hit = np.repeat(np.arange(len(row)), thrown)
        nth = np.arange(len(hit)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        dart = mix(cell[hit] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        coordinate = (mix(dart) >> np.uint64(33)).astype(np.int64) % k
    value = (rank[hit].astype(np.uint64) << np.uint64(50)) | (dart >> np.uint64(14))
    np.minimum.at(signature, doc[row[hit]] * k + coordinate, value)


def signatures(sets: list[np.ndarray], k: int = ROWS * BANDS) -> np.ndarray:
    """One row of `k` coordinates for each set of units; an empty set's row is all MAX."""
    sizes = np.array([len(s) for s in sets], np.int64)
    signature = np.full(len(sets) * k, MAX, np.uint64)
    need = k * np.log(k) + 2 * k
    layers = np.ceil(need / np.maximum(sizes, 1)).astype(np.int64)
    first = np.zeros(len(sets), np.int64)
    todo = np.flatnonzero(sizes)
    while len(todo):
        doc = np.repeat(todo, sizes[todo])
        _darts(doc, np.concatenate([sets[i] for i in todo]), first[doc], layers[doc], k, signature)
        first[todo] += layers[todo]
        todo = todo[(signature.reshape(-1, k)[todo] == MAX).any(axis=1)]
    return signature.reshape(-1, k)


def _bands(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in parts(batches, "text"):
        words = [x.split() for x in payloads(batch, "text")]
        sets = [units(shingles(known.of(w), WIDTH)) for w in words]
        keys = _bands(signatures(sets))
        digest = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(digest, pa.binary()), lists], ["id", "row", "digest", "bands"])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of units."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return common / (len(a) + len(b) - common)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, held = WordHashes(), {}
    for batch in parts(batches, "text_a"):
        found = []
        for (i, x), (j, y) in zip(zip(batch.column("a").to_pylist(), payloads(batch, "text_a")), zip(batch.column("b").to_pylist(), payloads(batch, "text_b"))):
            pair = []
            for n, text in ((i, x), (j, y)):
                if n not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[n] = units(shingles(known.of(text.split()), WIDTH))
                pair.append(held[n])
            found.append(weighted_jaccard(*pair))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def _near(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """(id, text): the texts of the nodes `id` in `wanted`, each once."""
    places = nodes.select(F.col("node"), "id", "row").join(wanted.select(F.col("id").alias("node")).distinct(), "node")
    return settled(texts.join(places, ["id", "row"]).select(F.col("node").alias("id"), "text").dropDuplicates(["id"]), path)


def compared(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b, similarity) of distinct pairs (a, b) of ids in `near` (id, text)."""
    one = near.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = near.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a long, b long, similarity double")


def _links_within(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the documents of two blocks, as many as are needed to connect what they connect."""
    known = WordHashes()
    ids, sets, of = [], [], {}
    for side in (left, right):
        for batch in side.select(["id", "text"]).to_batches():
            for i, text in zip(batch.column("id").to_pylist(), payloads(batch, "text")):
                if i not in of:
                    of[i] = len(ids)
                    ids.append(i)
                    sets.append(units(shingles(known.of(text.split()), WIDTH)))
    sizes = np.array([len(x) for x in sets], np.int64)
    whole = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(whole, kind="stable")
    whole, owner = whole[order], owner[order]
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for x in sorted({of[i] for i in left.column("id").to_pylist()}):
        first, last = np.searchsorted(whole, sets[x], "left"), np.searchsorted(whole, sets[x], "right")
        count = last - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        common = np.bincount(owner[at], minlength=len(ids))
        near = common >= SIMILARITY * (sizes[x] + sizes - common)
        for y in np.flatnonzero(near).tolist():
            if y != x and root(x) != root(y):
                parent[root(x)] = root(y)
                a.append(min(ids[x], ids[y]))
                b.append(max(ids[x], ids[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _leftover_links(members: DataFrame, links: DataFrame, hubs: DataFrame, nodes: DataFrame, texts: DataFrame, folder: str, block: int = 256) -> DataFrame:
    """Links of the bucket members that have none to their hub, with all members of their bucket."""
    state = members.select("bucket", "id").join(hubs, "bucket").withColumns({"x": F.least("id", "hub"), "y": F.greatest("id", "hub")})
    near = links.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(True).alias("linked"))
    outside = (F.col("id") != F.col("hub")) & F.col("linked").isNull()
    state = settled(state.join(near, ["x", "y"], "left").select("bucket", "id", outside.alias("outside")), f"{folder}/state")
    blocks = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    counts = state.groupBy("bucket").agg(blocks(F.count_if("outside")).alias("rows"), blocks(F.count(F.lit(1))).alias("columns"), F.count_if("outside").alias("n")).where("n > 0").drop("n")
    dealt = settled(state.join(counts, "bucket"), f"{folder}/dealt")
    near = _near(dealt, nodes, texts, f"{folder}/near-leftover")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = dealt.where("outside").select("bucket", "id", own("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j")).join(near, "id")
    right = dealt.select("bucket", "id", own("columns").alias("j"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i")).join(near, "id")
    left, right = (x.select(*[F.col(c).alias(f"{side}_{c}" if c not in ("id", "text") else c) for c in ("bucket", "i", "j", "id", "text")]) for side, x in (("l", left), ("r", right)))
    found = left.groupBy("l_bucket", "l_i", "l_j").cogroup(right.groupBy("r_bucket", "r_i", "r_j")).applyInArrow(_links_within, "a long, b long")
    found = settled(found.distinct(), f"{folder}/leftover")
    drop_folder(members.sparkSession, *(f"{folder}/{x}" for x in ("state", "dealt", "near-leftover")))
    return found


def _heads(texts: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(id, row, digest) of each row of `texts`, and (digest, head) of each distinct text: the first (id, row) of its class."""
    spark = texts.sparkSession
    signed = settled(texts.mapInArrow(_sign, "id long, row long, digest binary, bands array<long>"), f"{folder}/signed")
    place = F.struct("id", "row")
    copies = signed.where("digest is not null").groupBy("digest").agg(F.min(place).alias("first"), F.first("bands").alias("bands"))
    # Numbers are given as the table is written, so they hold from then on.
    copies = settled(copies.select(F.monotonically_increasing_id().alias("node"), "digest", "first.*", "bands"), f"{folder}/copies")
    rows, nodes = settled(signed.drop("bands"), f"{folder}/rows"), settled(copies.drop("bands"), f"{folder}/nodes")
    met = copies.select(F.col("node").alias("id"), F.explode("bands").alias("bucket"))
    members = settled(met.join(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket"), f"{folder}/members")
    drop_folder(spark, f"{folder}/signed", f"{folder}/copies")
    # The hub of a bucket is its member that meets most others over all buckets: the original of a crowd of variants.
    score = members.groupBy("id").agg(F.sum(F.col("n") - 1).alias("score"))
    hubs = members.join(score, "id").groupBy("bucket").agg((-F.max(F.struct("score", (-F.col("id")).alias("id")))["id"]).alias("hub"))
    hubs = settled(hubs, f"{folder}/hubs")
    pairs = members.join(hubs, "bucket").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    pairs = settled(pairs, f"{folder}/pairs")
    near = _near(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), nodes, texts, f"{folder}/near")
    links = settled(compared(pairs, near).where(F.col("similarity") >= SIMILARITY).select("a", "b"), f"{folder}/links")
    drop_folder(spark, f"{folder}/pairs", f"{folder}/near")
    leftover = _leftover_links(members, links, hubs, nodes, texts, folder)
    drop_folder(spark, f"{folder}/members", f"{folder}/hubs")
    linked = components(links.union(leftover), f"{folder}/linked").join(nodes.select("node", "id", "row"), "node")
    first = linked.groupBy("component").agg(F.min(place).alias("head"))
    linked = linked.join(first, "component").select("node", "head")
    return rows, nodes.join(linked, "node", "left").select("digest", F.coalesce("head", place).alias("head"))


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc, class_id), the smallest id of its class."""
    rows, heads = _heads(keyed(docs, doc, text), scratch(docs.sparkSession))
    known = lambda x: F.when(x != LAST, x)
    return rows.join(heads, "digest", "left").select(known(F.col("id")).alias(doc), known(F.coalesce("head.id", "id")).alias("class_id"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of `docs` of each class, and all blank rows, with the columns of `docs`."""
    _, heads = _heads(keyed(docs, doc, text), scratch(docs.sparkSession))
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.coalesce(F.col(doc).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("row"), blank.alias("blank"))
    first = heads.select("head.id", "head.row").distinct()
    kept = rows.where("not blank").dropDuplicates(["id", "row"]).join(first, ["id", "row"], "left_semi")
    return kept.select("__row.*").union(rows.where("blank").select("__row.*"))


def query(docs: DataFrame) -> DataFrame:
    return classes(docs)


#: Exact classes, which the signatures find but for a chance of about one in ten thousand a link at the limit itself.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, array_to_string(w[p : p + 4], ' ') AS g, count(*) AS c
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0) GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE i >= 0.8 * (a.n + b.n - i)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT d.doc_id, least(d.doc_id, coalesce(m.y, d.doc_id)) AS class_id FROM d LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""
