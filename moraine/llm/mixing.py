"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w, u being uniform from a hash
of its id and w its quality weight; within a source, documents stand in the
order of their keys.  A source whose target is e times its size and a remainder
gives e complete epochs first; the remainder is the prefix of that order whose
running size comes nearest to it.

The running size is a two-level prefix sum.  Keys map to (0, 1) by the monotone
1 - exp(-key); that range is cut into buckets (about `bucket_rows` rows each in
the largest source), bucket totals are summed first, and a window then runs
inside single buckets only.  No task holds a source, however hot it is.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, the last; rows with equal ids, sources and texts stand side
by side and count one by one (a hash of the text and their number break ties);
an empty table gives an empty table; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, scratch, settled

#: No document is used more often than this, so no target is above so many times its source's size.
MOST = 3
_SYMBOLS = r"[^#*$%&|<>]+"


def size_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Longer texts and texts with fewer symbols weigh more; always in [0.05, 1)."""
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), _SYMBOLS, ""))
    return F.greatest(F.lit(0.05), size.cast("double") / (size + 50).cast("double") * (F.lit(1.0) - F.least(F.lit(1.0), symbols.cast("double") / F.greatest(size, F.lit(1)).cast("double"))))


def _key_of(source: Column) -> Column:
    """A key that is never null; a null source has one of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets_of(sources: DataFrame, weight: Column, most: int = MOST) -> DataFrame:
    """Adds `target` to (source, source_size): all words shared by weight, capped at `most` times a source's size.

    Capping and sharing the excess again until none is above is water-filling: the
    sources that hit their cap are those with the smallest size per weight, and
    what is left is shared by the others.  `sources` has one row per source.
    """
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    ranked = ranked.withColumns(
        {
            "total": F.sum("source_size").over(every),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # The level if this source and all with a larger ratio stay below their caps; the true level is the first that
    # holds, and sources before it are at their caps.
    ranked = ranked.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level").alias("level")))).over(every)["level"]
    return ranked.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))).drop("total", "capped", "open", "level", "cap", "weight")


def mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", bucket_rows: int = 5_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: (doc, source, size, source_size, target, taken, uses) and the columns `keep`."""
    t = F.col(text)
    sized = docs.select(
        F.col(doc).alias("__doc"), F.col(source).alias("__source"), size_of(t).alias("__size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc).cast("string"), F.lit("")))).alias("__digest"),
        F.xxhash64(t).alias("__tie"), t.alias("__text"), _key_of(F.col(source)).alias("__s"), F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("none")]).alias("__keep"),
    )
    uniform = (F.conv(F.substring("__digest", 1, 12), 16, 10).cast("double") + 1.0) / F.lit(float(2**48 + 1))
    keyed = sized.withColumn("__weight", quality_weight(F.col("__text"), F.col("__size"))).withColumn("__key", F.round(-F.log(uniform) / F.col("__weight"), 12))
    keyed = keyed.drop("__text")
    sources = docs.select(F.col(source).alias("__source"), size_of(t).alias("__size")).groupBy("__source").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # One row per source, written out: its size is known when the join below is planned, so that texts aren't dealt
    # out by source to meet it unless it is large.
    sources = settled(sources, f"{scratch(docs.sparkSession)}/sources")
    places = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1)
    targets = targets_of(places, F.col("place") % 3 + 1).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).select(
        _key_of(F.col("__source")).alias("s"), "source_size", "target", "epochs", "rest", F.greatest(F.ceil(F.col("n") / bucket_rows), F.lit(1)).alias("buckets")
    )
    joined = keyed.join(targets, keyed["__s"] == targets["s"]).drop("s")
    joined = joined.withColumn("bucket", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("__key"))) * F.col("buckets")), F.col("buckets") - 1))
    # The window and the join below share keys, so rows with their texts are dealt out once.
    totals = joined.groupBy("__s", "bucket").agg(F.sum("__size").alias("held"))
    ahead = totals.select(
        F.col("__s").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("held").over(Window.partitionBy("__s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    inside = Window.partitionBy("__s", "bucket").orderBy("__key", "__doc", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = joined.withColumn("upto", F.sum("__size").over(inside))
    summed = summed.join(ahead, (summed["__s"] == ahead["s"]) & (summed["bucket"] == ahead["b"])).withColumn("upto", F.col("upto") + F.col("ahead"))
    # In if the running size is within the rest, or oversteps it by less than it would fall short without this document.
    inside_rest = (F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("rest")) < (F.col("rest") - (F.col("upto") - F.col("__size"))))
    uses = (F.col("epochs") + F.when(inside_rest & (F.col("__size") > 0), 1).otherwise(0)).cast("long")
    uses = F.when(F.col("__size") > 0, uses).otherwise(F.lit(0).cast("long"))
    return summed.withColumn("uses", uses).select(
        F.col("__doc").alias(doc), F.col("__source").alias(source), F.col("__size").alias("size"), "source_size", F.col("target").cast("double").alias("target"),
        (F.col("uses") * F.col("__size")).alias("taken"), "uses", *[F.col(f"__keep.{c}").alias(f"__keep_{c}") for c in keep],
    )


def sample(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is used, with the columns of `docs`."""
    out = mix(docs, keep=tuple(docs.columns)).where("uses > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int")))).select(*[F.col(f"__keep_{c}").alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT)::DOUBLE + 1.0) / 281474976710657.0 AS u
  FROM documents),
k AS (
  SELECT *, round(-ln(u) / greatest(0.05::DOUBLE, size::DOUBLE / (size + 50)::DOUBLE
         * (1.0::DOUBLE - least(1.0::DOUBLE, length(regexp_replace(text, '{_SYMBOLS}', '', 'g'))::DOUBLE / greatest(size, 1)::DOUBLE))), 12) AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (3 * sum(size))::DOUBLE AS cap,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
  FROM s),
t AS (SELECT source, source_size, least(cap, (SELECT lv FROM r WHERE lv * w <= cap ORDER BY cap / w, source LIMIT 1) * w) AS target FROM r),
o AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, floor(t.target / t.source_size) AS epochs,
         t.target - floor(t.target / t.source_size) * t.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (epochs + CASE WHEN upto <= rest OR upto - rest < rest - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
