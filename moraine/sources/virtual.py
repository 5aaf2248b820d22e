"""The driver's tables as a tree of files, and its order lines as extents of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXTS = {
    "documents": ("concat(source, '/', lang, '/doc_', doc_id, '.txt')", "text"),
    "pages": ("concat('pages/', page_id, '.html')", "html"),
    "conversations": ("concat('conv/', conv_id, '/', turn, '_', role, '.md')", "text"),
    "benchmark": ("concat('bench/item_', item_id, '.txt')", "text"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """(path, size, hash) of every file, and its content as binary if asked for."""
    out = None
    for name, (path, text) in _TEXTS.items():
        data = F.coalesce(F.col(text), F.lit("")).cast("binary")
        part = read(spark, sf_dir, name).select(
            F.expr(path).alias("path"), F.octet_length(data).cast("long").alias("size"), F.substring(F.sha2(data, 256), 1, 32).alias("hash"), *([data.alias("content")] if content else [])
        )
        out = part if out is None else out.unionByName(part)
    return out


TREE = """tree AS (
  SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, strlen(coalesce(text, ''))::BIGINT AS size, substr(sha256(coalesce(text, '')), 1, 32) AS hash FROM documents
  UNION ALL SELECT 'pages/' || page_id || '.html', strlen(coalesce(html, '')), substr(sha256(coalesce(html, '')), 1, 32) FROM pages
  UNION ALL SELECT 'conv/' || conv_id || '/' || turn || '_' || role || '.md', strlen(coalesce(text, '')), substr(sha256(coalesce(text, '')), 1, 32) FROM conversations
  UNION ALL SELECT 'bench/item_' || item_id || '.txt', strlen(coalesce(text, '')), substr(sha256(coalesce(text, '')), 1, 32) FROM benchmark)"""


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, pos, unit, len): all order lines, of a file per order."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("orders/"), "l_orderkey", F.lit(".rec")).alias("path"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("unit"), F.col("l_quantity").cast("long").alias("len")
    )


_KEPT = "l_returnflag = 'R' AND l_discount >= 0.08"


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit): units with extents of files that are still there.  The lines of removed files are left out, so some units are dead."""
    return read(spark, sf_dir, "lineitem").where(_KEPT).select(F.col("l_partkey").alias("unit")).distinct()


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, packed, unpacked, codec): one unit per part; it holds the bytes its extents name and some that nothing names."""
    held = extents(spark, sf_dir).groupBy("unit").agg(F.sum("len").alias("named"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), F.col("p_size").cast("long").alias("size"), F.floor("p_retailprice").cast("long").alias("price"))
    return parts.join(held, "unit", "left").select("unit", (F.col("size") + F.pmod("price", F.lit(97))).alias("packed"), (F.coalesce("named", F.lit(0)) + F.pmod("size", F.lit(4))).alias("unpacked"), F.pmod("size", F.lit(5)).cast("int").alias("codec"))


EXTENTS = """extents AS (
  SELECT 'orders/' || l_orderkey || '.rec' AS path, l_linenumber::BIGINT AS pos, l_partkey AS unit, l_quantity::BIGINT AS len FROM lineitem)"""
UNITS = (
    EXTENTS
    + """, named AS (SELECT unit, sum(len)::BIGINT AS named FROM extents GROUP BY unit), units AS (
  SELECT p_partkey AS unit, p_size::BIGINT + floor(p_retailprice)::BIGINT % 97 AS packed, coalesce(named, 0) + p_size::BIGINT % 4 AS unpacked, (p_size % 5)::INT AS codec
  FROM part LEFT JOIN named ON unit = p_partkey)"""
)
LIVE = UNITS + f", live AS (SELECT * FROM units WHERE unit IN (SELECT l_partkey FROM lineitem WHERE {_KEPT}))"
