"""Counts and shares of memories and events, growth over periods, milestones, and access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.time import month_label, quarter_label, week_label

WINDOWS = {"week": 7, "month": 30, "quarter": 90}


def distribution(items: DataFrame, column: str) -> DataFrame:
    """(name, count), most frequent first, then by name."""
    return items.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name")


def distributions(items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimension, name, count) of several columns, from one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("name")) for c in columns))).alias("p")
    return items.select(pairs).groupBy("p.dimension", "p.name").agg(F.count("*").alias("count"))


def top_tags(items: DataFrame, top: int = 10) -> DataFrame:
    return items.select(F.explode("tags").alias("name")).groupBy("name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name").limit(top)


def _share(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)


def summary(items: DataFrame, events: DataFrame) -> DataFrame:
    """One row: events, memories, memories for each event, the shared ones' share, and mean confidence and stability; 0 where there is nothing to divide by."""
    m = items.agg(F.count("*").alias("memory_count"), F.count_if(F.col("tool") == "shared").alias("shared"), F.avg("confidence").alias("c"), F.avg("stability").alias("s"), F.count_if(F.col("status") == "candidate").alias("candidate_count"))
    e = events.agg(F.count("*").alias("raw_event_count"))
    return m.join(F.broadcast(e)).select(
        "raw_event_count",
        "memory_count",
        "candidate_count",
        _share(F.col("memory_count"), F.col("raw_event_count"), 6).alias("memory_conversion_ratio"),
        _share(F.col("shared"), F.col("memory_count"), 4).alias("shared_memory_ratio"),
        F.round(F.coalesce("c", F.lit(0.0)), 4).alias("avg_confidence"),
        F.round(F.coalesce("s", F.lit(0.0)), 4).alias("avg_stability"),
    )


def longest(items: DataFrame, top: int = 10) -> DataFrame:
    return items.select("id", "title", "tool", "status", F.length(F.coalesce("details", F.lit(""))).alias("detail_length")).orderBy(F.desc("detail_length"), "id").limit(top)


def most_recent(items: DataFrame, top: int = 10) -> DataFrame:
    seen = F.coalesce("last_seen_at", "created_at")
    return items.select("id", "title", "tool", "status", seen.alias("seen_at")).orderBy(F.desc("seen_at"), "id").limit(top)


def low_confidence(items: DataFrame, below: float = 0.78) -> DataFrame:
    return items.filter(F.col("confidence") < below).select("id", "title", "tool", "confidence", "status")


def milestone(active: Column) -> Column:
    """struct(reached, next, progress_pct) of a count of active memories; null below the first milestone."""
    steps = F.array(*map(F.lit, V.MILESTONES))
    reached = F.array_max(F.filter(steps, lambda m: m <= active))
    following = F.array_min(F.filter(steps, lambda m: m > active))
    return F.when(reached.isNotNull(), F.struct(reached.alias("reached"), following.alias("next"), F.least(F.lit(100.0), F.round(active / (reached + 50) * 100, 1)).alias("progress_pct")))


def growth(items: DataFrame, access: DataFrame, as_of: Column, period: str = "week") -> DataFrame:
    """One row about active memories: all, new in the period's window, ever used, their share, mean confidence and
    stability, the period's label and the milestone. access: (id, usage_count, last_accessed_at)."""
    days = WINDOWS.get(period, 7)
    label = {"month": month_label, "quarter": quarter_label}.get(period, week_label)(as_of)
    moment = F.coalesce("last_seen_at", "created_at")
    active = items.filter(F.col("status") == "active").join(access.select("id", "last_accessed_at"), "id", "left")
    row = active.agg(
        F.count("*").alias("total_active"),
        F.count_if(moment >= as_of - F.expr(f"interval {days} days")).alias("new_this_period"),
        F.count("last_accessed_at").alias("ever_used"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"),
        F.round(F.coalesce(F.avg("stability"), F.lit(0.0)), 3).alias("avg_stability"),
    )
    return row.withColumn("period", F.lit(period)).withColumn("label", label).withColumn("window_days", F.lit(days)).withColumn("usage_rate", _share(F.col("ever_used"), F.col("total_active"), 3)).withColumn("milestone", milestone(F.col("total_active")))


def access_counts(log: DataFrame, id_: str = "id", ts: str = "ts") -> DataFrame:
    """(id, usage_count, last_accessed_at) of an append-only log of accesses."""
    return log.groupBy(F.col(id_).alias("id")).agg(F.count("*").alias("usage_count"), F.max(ts).alias("last_accessed_at"))


def frequently_used(items: DataFrame, access: DataFrame, top: int = 10) -> DataFrame:
    """Active memories by 10 for each use and 1 for any."""
    rows = items.filter(F.col("status") == "active").join(access, "id").withColumn("usage_score", F.col("usage_count") * 10 + F.when(F.col("last_accessed_at").isNotNull(), 1).otherwise(0))
    return rows.orderBy(F.desc("usage_score"), "id").limit(top)


def skill_stats(skills: DataFrame) -> DataFrame:
    """One row: skills by status, uses, successes and failures, and the rate of success."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("draft", "active", "archived")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("usage_count", "success_count", "failure_count")]
    return skills.agg(F.count("*").alias("total"), *by, *sums).withColumn("success_rate", _share(F.col("success_count"), F.col("usage_count"), 4))


def needs_improvement(skills: DataFrame, min_usage: int = 5, below: float = 0.6) -> DataFrame:
    return skills.filter((F.col("usage_count") >= min_usage) & (F.col("success_count") / F.col("usage_count") < below))


def for_review(skills: DataFrame, min_usage: int = 5, below: float = 0.6) -> DataFrame:
    """Drafts and what needs improvement, each once."""
    drafts = skills.filter(F.col("status") == "draft").withColumn("reason", F.lit("draft"))
    return drafts.unionByName(needs_improvement(skills.filter(F.col("status") != "draft"), min_usage, below).withColumn("reason", F.lit("low_success")))


def stale(digests: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Active digests with open follow-ups that are older than so many days."""
    old = F.unix_timestamp(as_of) - F.unix_timestamp("created_at") > days * 86400
    return digests.filter((F.col("status") == "active") & (F.size("follow_ups") > 0) & old)


def feedback_totals(feedback: DataFrame) -> DataFrame:
    """Uses, successes and failures of each skill from an append-only feedback log (skill_id, success)."""
    return feedback.groupBy("skill_id").agg(F.count("*").alias("usage_count"), F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"))


def growth_shares(items: DataFrame) -> DataFrame:
    """(dimension, value, count) of active memories by type and by scope."""
    rows = items.filter(F.col("status") == "active").select(F.explode(F.array(*(F.struct(F.lit(name).alias("dimension"), F.col(c).alias("value")) for name, c in (("type", "memory_type"), ("scope", "scope"))))).alias("d"))
    return rows.groupBy("d.dimension", "d.value").agg(F.count("*").alias("count"))
