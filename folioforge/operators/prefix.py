"""Running totals over a whole table, without one task that sees it whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def running_before(rows: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """`rows` with the sum of `value` over all rows that come earlier by `order` (nulls first), 0 for the first.

    Rows are dealt out in ranges and summed range by range; the ranges' totals, one row each, are summed in turn. Equal rows by
    `order` are told apart in no particular way, so `order` should name each row once.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x, _ = staged(rows.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    totals = x.groupBy("range_").agg(F.sum(value).alias("total_"))
    firsts = totals.select("range_", (F.sum("total_").over(Window.orderBy("range_")) - F.col("total_")).alias("first_"))
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return x.join(F.broadcast(firsts), "range_").withColumn(name, (F.col("first_") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("range_", "first_")
