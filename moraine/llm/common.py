"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder, which `spark.checkpoint.dir` has to name."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/moraine-checkpoints"  # one machine, one process
    return f"{root.rstrip('/')}/moraine-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, path: str) -> DataFrame:
    """`df` written to `path` and read back: its lineage ends in shared files, so lost executors cost nothing before it.

    The write's shuffle files go as soon as it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, *paths: str) -> None:
    """Removes folders of `settled` tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: The place of rows without an id among those that have one.
LAST = 9_223_372_036_854_775_807


def keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(id, row, text) of `docs`: `id` is a long, a null one `LAST`, and `row` tells rows of equal ids apart by their texts."""
    return docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
