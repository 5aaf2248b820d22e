"""Numbers and running sums over a total order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import settled


def running(df: DataFrame, keys: list[str], folder: str, number: str = "seq", sums: dict[str, str] | None = None) -> DataFrame:
    """Adds `number` (from 0) and, for each name: column in `sums`, the sum of the column over all rows before.

    Rows are dealt out by ranges of the keys and written once; each range is
    numbered on its own and shifted by the totals of the ranges before it, a table
    of one row per range.
    """
    sums = sums or {}
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(ranges, *[F.col(k) for k in keys]).withColumn("__part", F.spark_partition_id()), f"{folder}/ranges")
    inside = Window.partitionBy("__part").orderBy(*keys)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn(number, (F.row_number().over(inside) - 1).cast("long"))
    for name, column in sums.items():
        rows = rows.withColumn(name, F.coalesce(F.sum(column).over(before), F.lit(0)).cast("long"))
    totals = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = lambda column: F.coalesce(F.sum(column).over(ahead), F.lit(0)).cast("long")
    shifts = totals.select("__part", shift("__rows").alias("__ahead"), *[shift(f"__sum_{n}").alias(f"__ahead_{n}") for n in sums])
    out = rows.join(F.broadcast(shifts), "__part")  # a row per range: bounded by the number of shuffle partitions
    out = out.withColumn(number, F.col(number) + F.col("__ahead"))
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"__ahead_{name}"))
    return out.drop("__part", "__ahead", *[f"__ahead_{n}" for n in sums])


def upper_median(df: DataFrame, column: str) -> Column:
    """The value at place n div 2 (from 0) of the sorted values, 0 if there are none, as a scalar subquery.

    Values are counted first, so the window runs over distinct values.
    """
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return F.coalesce(upto.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("v").alias("v")).scalar(), F.lit(0))
