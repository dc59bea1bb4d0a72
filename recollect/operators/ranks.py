"""Numbers within groups of any size: no group has to fit in a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.model import stored


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "entry_no") -> DataFrame:
    """rows with their number (from 1) within each group of the columns `by`, in an order that tells all rows apart.

    A window over a group puts the group in one task. Here rows are dealt by ranges of group and order, so that a large
    group is spread over the ranges that it fills; rows are numbered within their range, and the counts of a group's
    earlier ranges are added. A range begins in the middle of one group at most, so there are no more such sums than
    ranges, and they are broadcast. The ranges are written to the shared folder: their borders are drawn once.
    """
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = stored(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    counts = placed.groupBy(*by, "_range").agg(F.count("*").alias("_count"))
    before = F.sum("_count").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = counts.withColumn("_before", before).filter("_before is not null").select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), "_before")
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_at"))
    joined = placed.withColumn("_own", own).join(F.broadcast(sums), same, "left")
    return joined.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by their keys over as many partitions as shuffles have, and four for each core at least, whatever their size.

    For few rows that cost much each (texts that are compared), which adaptive execution would put into one task by their bytes.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys)
