"""Incremental ingestion: new files become raw events once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_new(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", **options: str) -> DataFrame:
    """A stream of the rows of files as they land."""
    return spark.readStream.schema(schema).format(form).options(**options).load(path)


def land_new(stream: DataFrame, key: str, target: str, checkpoint: str, watermark: tuple[str, str] | None = None, parts: int = 64) -> None:
    """Append the stream's new rows to the table in target, rows with a known key left out, and stop when all files are read.

    The target is dealt by a hash of the key into `parts` folders (as many as when it was begun). Each micro-batch looks for
    its keys in the parts that they fall into, in their column of keys alone, and within the range of hashes that it has
    (files are sorted by it); a batch that is replayed after a failure adds nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("_hash", F.xxhash64(key)).withColumn("_part", F.pmod("_hash", F.lit(parts)).cast("int"))
        # a row for each part at most
        ranges = fresh.groupBy("_part").agg(F.min("_hash"), F.max("_hash")).collect()
        try:
            known = spark.read.schema(fresh.schema).parquet(target)
        except Exception as e:  # the table isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None and ranges:
            fresh = fresh.join(known_parts(known, ranges).select(key), key, "left_anti")
        fresh.repartition("_part").sortWithinPartitions("_part", "_hash").write.mode("append").partitionBy("_part").parquet(target)

    if watermark:
        stream = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def known_parts(known: DataFrame, ranges: Sequence[tuple[int, int, int]]) -> DataFrame:
    """The rows of a landed table in some parts, each within a range of hashes: (part, least, greatest)."""
    low, high = min(r[1] for r in ranges), max(r[2] for r in ranges)
    return known.filter(F.col("_part").isin(*(r[0] for r in ranges)) & F.col("_hash").between(low, high))
