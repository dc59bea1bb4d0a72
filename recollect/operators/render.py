"""Where memories are kept, and what is rendered from them for people and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import excerpt
from ..functions.time import time_ago

#: Folder of each memory type.
FOLDERS = {"profile": "profile", "procedural": "procedures", "semantic": "patterns", "episodic": "episodes"}


def route() -> Column:
    """Folder of a memory: candidates wait in the inbox, a project's lie with it, the rest by type."""
    by_type = F.lit("patterns")
    for kind, folder in FOLDERS.items():
        by_type = F.when(F.col("memory_type") == kind, folder).otherwise(by_type)
    return F.when(F.col("status") == "candidate", "inbox").when((F.col("scope") == "project") & F.col("project_key").isNotNull(), F.concat(F.lit("projects/"), F.col("project_key"), F.lit("/memories"))).otherwise(by_type)


def write_routed(items: DataFrame, path: str) -> None:
    """Write memories as Parquet, partitioned by their folder; a memory that moves is written once, in its new folder."""
    items.withColumn("route", route()).write.mode("overwrite").partitionBy("route").parquet(path)


def stars(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "★★★").when(confidence >= 0.75, "★★☆").when(confidence >= 0.65, "★☆☆").otherwise("☆☆☆")


def bullet(as_of: Column, sources: Column, last_source: Column) -> Column:
    """A memory as a list entry with its certainty, number of sources, last source and age."""
    age = time_ago(F.coalesce("last_seen_at", "created_at"), as_of)
    plain = F.concat(F.lit("- **["), stars(F.col("confidence")), F.lit("] "), F.col("title"), F.lit("**  (conf:"), F.format_string("%.2f", "confidence"), F.lit(", stab:"), F.format_string("%.2f", "stability"), F.lit(")\n  来源："), sources.cast("string"), F.lit("个来源 | 最新："), F.initcap(last_source), F.lit(" · "), age)
    struck = F.concat(F.lit("- ~~["), stars(F.col("confidence")), F.lit("] ~~"), F.col("title"), F.lit("~~~~  (已矛盾，"), F.initcap(last_source), F.lit(" · "), age, F.lit(")"))
    return F.when(F.col("status") == "contradicted", struck).otherwise(plain)


def sections() -> Column:
    """The sections of the general pages in which a memory stands."""
    kind, scope = F.col("memory_type"), F.col("scope")
    return F.array_compact(
        F.array(
            F.when((kind == "profile") & (scope == "global"), "personal-profile"),
            F.when((kind == "procedural") & scope.isin("global", "tool"), "working-style"),
            F.when(F.array_contains("tags", "watchout"), "watch-outs"),
        )
    )


def project_sections() -> Column:
    """The sections of its project's page in which a memory stands."""
    tagged = lambda *tags: F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    return F.array_compact(
        F.array(
            F.when((F.col("memory_type") == "semantic") | tagged("architecture"), "Architecture"),
            F.when(tagged("commands", "maven"), "Commands"),
            F.when(tagged("constraint", "coding-style"), "Constraints"),
            F.when(tagged("watchout", "local-sdk"), "Watch Outs"),
        )
    )


def listed(items: DataFrame, in_sections: Column, line: Column, most: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., section, rank, id, line): the surest and steadiest of each section, at most `most`."""
    rows = items.withColumn("section", F.explode(in_sections)).withColumn("line", line)
    place = F.row_number().over(Window.partitionBy(*by, "section").orderBy(F.desc("confidence"), F.desc("stability"), "title", "id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= most).select(*by, "section", "rank", "id", "line")


def page(lines: DataFrame, title: Column, *by: str) -> DataFrame:
    """(by..., content): sections in Markdown, from at most `most` lines each."""
    parts = lines.groupBy(*by, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda x: F.concat(F.lit("## "), x["section"], F.lit("\n"), x["body"], F.lit("\n"))), "\n")
    return parts.groupBy(*by).agg(text.alias("body")).select(*by, F.concat(F.lit("# "), title, F.lit("\n\n"), "body").alias("content"))


def imported_notes(notes: DataFrame, known: DataFrame, least: int = 50) -> DataFrame:
    """Notes written by hand that aren't known yet and are long enough, as sure candidates (0.92, 0.95)."""
    fresh = notes.join(known.select("id"), "id", "left_anti").filter(F.length(F.trim("text")) >= least)
    return fresh.select("id", excerpt("text", 60).alias("title"), excerpt("text", 180).alias("summary"), F.col("text").alias("details"), F.lit(0.92).alias("confidence"), F.lit(0.95).alias("stability"), F.lit("candidate").alias("status"))
