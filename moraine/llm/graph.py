"""Connected components of a large graph, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, settled


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): the smallest node that `node` is connected with; nodes without edges don't appear.

    `edges` has columns a and b.  Each round points every node's larger
    neighbours, and then its smaller ones, to the smallest node around it; it ends
    when all trees are stars: every `hi` has one `lo`, and no node is both.  A
    round's rows are written out, so no lineage grows
    and lost executors repeat one round at most, and the rows before them go; hubs
    are only ever the key of a sum or of a join that can be split.
    """
    now = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    now = settled(now, f"{folder}/edges-0")
    step = 0
    while True:
        step += 1
        both = now.union(now.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select(F.explode(F.array(F.col("hi"), F.col("lo"))).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        now = settled(small, f"{folder}/edges-{step}")
        drop_folder(edges.sparkSession, f"{folder}/edges-{step - 1}")
        torn = now.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if torn.isEmpty() and now.select(F.col("hi").alias("n")).join(now.select(F.col("lo").alias("n")), "n", "left_semi").isEmpty():
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
