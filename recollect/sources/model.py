"""The tables of the model, and how the driver's tables stand for them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import excerpt, stable_id

EVIDENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("source_tool", "source_path", "session_id", "timestamp", "excerpt")])
RAW_EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "source_tool", "source_path", "session_id", "event_type", "timestamp", "role", "cwd", "project_key", "text", "command", "raw_json")])
MEMORY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "memory_type", "scope", "tool", "project_key", "summary", "details")]
    + [T.StructField("evidence", T.ArrayType(EVIDENCE)), T.StructField("confidence", T.DoubleType()), T.StructField("stability", T.DoubleType()), T.StructField("sensitivity", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("created_at", "last_seen_at", "reviewed_at", "status", "supersedes", "managed_by")]
    + [T.StructField("manual_override", T.BooleanType()), T.StructField("last_accessed_at", T.StringType()), T.StructField("expiration_days", T.IntegerType())]
)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: worked out once, whatever reads it and whoever is lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores: where it has fewer than two partitions for each core (small files, which may be of one row group), its rows are dealt by a hash of the key."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores, key)


def read_memories(spark: SparkSession, *roots: str) -> DataFrame:
    """Memory records in JSON files (one record or a list each) under some folders, with the file's path and time; records
    that don't hold together are left out. Files are read whole, one record each, as they are kept."""
    found = spark.read.schema(MEMORY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(list(roots))
    return valid(found.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified_at")))


def valid(memories: DataFrame) -> DataFrame:
    """Records that hold together: required fields are there, confidence and stability lie in 0..1."""
    needed = ("id", "title", "memory_type", "scope", "tool", "summary", "status")
    fine = F.lit(True)
    for n in needed:
        fine = fine & F.col(n).isNotNull()
    return memories.filter(fine & F.col("confidence").between(0, 1) & F.col("stability").between(0, 1))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge items: one for each document, judged by its label; deterministic, and the same in MEMORIES_SQL."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    kinds = F.array(*map(F.lit, ("procedural", "profile", "semantic", "episodic")))
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        excerpt("text", 60).alias("title"),
        excerpt("text", 180).alias("summary"),
        F.col("text").alias("details"),
        F.when(F.col("doc_id") % 5 == 0, "shared").otherwise(F.col("source")).alias("tool"),
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("project_key"),
        F.when(F.col("doc_id") % 3 != 0, "project").otherwise("global").alias("scope"),
        F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("memory_type"),
        F.when(F.col("toxic") == 1, 0.4).when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.6).otherwise(0.7).alias("confidence"),
        (F.lit(50) + F.least(F.floor(F.col("n_chars") / 200), F.lit(49))).cast("double").alias("s100"),
        F.when(F.col("toxic") == 1, "archived").when(F.col("quality") == 1, "active").otherwise("candidate").alias("status"),
        F.concat(F.array("lang", "source"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("watchout"))).otherwise(F.array().cast("array<string>"))).alias("tags"),
        created.alias("created_at"),
        F.when(F.col("doc_id") % 2 == 0, F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600 + F.col("n_chars") * 60)).alias("last_seen_at"),
        (F.lit(30) + F.col("doc_id") % 60).alias("expiration_days"),
        F.coalesce(F.col("doc_id") % 11 == 0, F.lit(False)).alias("manual_override"),
    ).withColumn("stability", F.col("s100") / 100.0).drop("s100")


MEMORIES_SQL = r"""memories AS (
  SELECT *, s100 / 100e0 AS stability FROM (
  SELECT d.doc_id AS id, {title} AS title, {summary} AS summary, d.text AS details,
    CASE WHEN d.doc_id % 5 = 0 THEN 'shared' ELSE d.source END AS tool,
    CASE WHEN d.doc_id % 3 <> 0 THEN d.lang END AS project_key,
    CASE WHEN d.doc_id % 3 <> 0 THEN 'project' ELSE 'global' END AS scope,
    (['procedural','profile','semantic','episodic'])[(d.doc_id % 4 + 1)::INT] AS memory_type,
    CASE WHEN toxic = 1 THEN 0.4e0 WHEN quality = 1 THEN 0.9e0 WHEN quality = 0 THEN 0.6e0 ELSE 0.7e0 END AS confidence,
    (50 + least(d.n_chars // 200, 49))::DOUBLE AS s100,
    CASE WHEN toxic = 1 THEN 'archived' WHEN quality = 1 THEN 'active' ELSE 'candidate' END AS status,
    list_concat([d.lang, d.source], CASE WHEN d.doc_id % 7 = 0 THEN ['watchout'] ELSE [] END) AS tags,
    1704067200 + d.doc_id * 3600 AS created_s,
    CASE WHEN d.doc_id % 2 = 0 THEN 1704067200 + d.doc_id * 3600 + d.n_chars * 60 END AS seen_s,
    30 + d.doc_id % 60 AS expiration_days,
    coalesce(d.doc_id % 11 = 0, false) AS manual_override
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)
)"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as raw events."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        stable_id("conv_id", "turn", "role", "text").alias("id"),
        F.lit("chat").alias("source_tool"),
        F.concat(F.lit("conversations/"), F.col("conv_id").cast("string")).alias("source_path"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.lit("message").alias("event_type"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        "role",
        F.lit(None).cast("string").alias("cwd"),
        F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("team-"), (F.col("conv_id") % 10).cast("string"))).alias("project_key"),
        "text",
        F.col("turn").alias("line_no"),
    )
