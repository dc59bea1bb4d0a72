"""Quality of memories: duplicates, governance, repair, review, expiry and the signals of what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.text import excerpt, is_garbled, is_low_value_candidate, polarity, token_set
from ..functions.time import normalize, whole_days
from .distill import AUTO_CONFIDENCE, AUTO_STABILITY


def duplicate_key() -> Column:
    """Excerpt of the summary, lower-cased; memories with equal keys and projects say the same."""
    return excerpt(F.lower(F.coalesce("summary", F.lit(""))), 96)


def duplicate_clusters(items: DataFrame, status: str = "candidate") -> DataFrame:
    """(summary_key, project_key, count, first_id, last_id) of the keys that several memories of the status share; null projects are one."""
    rows = items.filter(F.col("status") == status).withColumn("summary_key", duplicate_key()).filter("summary_key <> ''")
    return rows.groupBy("summary_key", "project_key").agg(F.count("*").alias("count"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("count > 1")


def govern(items: DataFrame, keep: str = "id") -> DataFrame:
    """Candidates with new_status, action and new_tags: all but the first of each group of duplicates and what is of low
    value are archived, what is sure enough and needs no review becomes active, what needs it is marked.

    keep: the first of a group is that of smallest id, or (`confidence`) the surest. It is found by a minimum before the
    shuffle, so a group of any size weighs one row for each task.
    """
    rows = items.filter(F.col("status") == "candidate").withColumn("_key", duplicate_key())
    order = F.struct(F.lit(0.0).alias("c"), "id") if keep == "id" else F.struct((-F.col("confidence")).alias("c"), "id")
    first = rows.filter("_key <> ''").groupBy("_key", "project_key").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("_key", F.col("project_key").alias("_project"), F.col("_first.id").alias("_first_id"))
    rows = rows.join(first, (rows["_key"] == first["_key"]) & rows["project_key"].eqNullSafe(first["_project"]), "left").drop(first["_key"])
    duplicate = F.col("_first_id").isNotNull() & (F.col("id") != F.col("_first_id"))
    low = is_low_value_candidate("title", "summary", "details")
    review = F.array_contains("tags", "needs-review") | (F.col("scope") == "project") | (F.col("memory_type") == "profile")
    sure = (F.col("confidence") >= AUTO_CONFIDENCE) & (F.col("stability") >= AUTO_STABILITY)
    action = F.when(duplicate, "auto-merged-candidate").when(low, "low-value-archived").when(sure & ~review, "auto-promoted").when(review, "needs-review").otherwise("kept")
    rows = rows.withColumn("action", action)
    status = F.when(F.col("action").isin("auto-merged-candidate", "low-value-archived"), "archived").when(F.col("action") == "auto-promoted", "active").otherwise("candidate")
    tags = F.when(F.col("action") == "kept", F.col("tags")).otherwise(F.array_sort(F.array_union("tags", F.array("action"))))
    return rows.withColumn("new_status", status).withColumn("new_tags", tags).drop("_key", "_project", "_first_id")


def exclusive_p95(sorted_values: Column) -> Column:
    """The 95th percentile by the exclusive method over a sorted array; one value is itself, none is 0."""
    n = F.size(sorted_values)
    j = F.greatest(F.least(F.floor((n + 1) * 19 / 20), n - 1), F.lit(1)).cast("int")
    delta = (n + 1) * 19 - j * 20
    at = lambda i: F.try_element_at(sorted_values, i.cast("int"))
    return F.when(n == 0, 0.0).when(n == 1, at(F.lit(1))).otherwise((at(j) * (F.lit(20) - delta) + at(j + 1) * delta) / 20)


def age_p95(items: DataFrame, age: Column) -> DataFrame:
    """One row, p95: the exclusive 95th percentile of an age, by the two values next to it found by rank, however many rows there are.

    Ranks come from a distributed sort: rows are counted by value first, and the running sum goes over distinct values
    in ranges of the value, so no task holds all of them.
    """
    counts = items.select(age.alias("a")).filter("a is not null").groupBy("a").agg(F.count("*").alias("n"))
    parts = counts.select("*", F.floor(F.col("a")).alias("_part"))
    before = parts.groupBy("_part").agg(F.sum("n").alias("_m")).withColumn("_before", F.sum("_m").over(Window.orderBy("_part")) - F.col("_m"))
    ranked = parts.join(before, "_part").withColumn("hi", F.col("_before") + F.sum("n").over(Window.partitionBy("_part").orderBy("a"))).withColumn("lo", F.col("hi") - F.col("n"))
    total = items.select(age.alias("a")).agg(F.count("a").alias("_total"))
    joined = ranked.join(F.broadcast(total))
    m, n = F.col("_total") + 1, F.col("_total")
    j = F.greatest(F.least(F.floor(m * 19 / 20), n - 1), F.lit(1))
    value = lambda r: F.max(F.when((F.col("lo") < r) & (F.col("hi") >= r), F.col("a")))
    got = joined.agg(value(j).alias("x"), value(j + 1).alias("y"), F.max(m * 19 - j * 20).alias("delta"), F.max("_total").alias("_total"))
    return got.select(F.when(F.col("_total").isNull(), 0.0).when(F.col("_total") == 1, F.col("x")).otherwise((F.col("x") * (F.lit(20) - F.col("delta")) + F.col("y") * F.col("delta")) / 20).alias("p95"))


def candidate_health(items: DataFrame, as_of: Column) -> DataFrame:
    """One row: candidates, their 95th percentile of age in days, how many are garbled or of low value, and groups of duplicates."""
    rows = items.filter(F.col("status") == "candidate")
    garbled = is_garbled("title") | is_garbled("summary") | is_garbled("details")
    counts = rows.agg(F.count("*").alias("candidate_count"), F.count_if(garbled).alias("garbled_candidate_count"), F.count_if(is_low_value_candidate("title", "summary", "details")).alias("low_value_candidate_count"))
    age = F.greatest((F.unix_timestamp(as_of) - F.unix_timestamp("created_at")) / 86400.0, F.lit(0.0))
    return counts.join(F.broadcast(age_p95(rows, age).select(F.round("p95", 2).alias("candidate_age_p95")))).join(F.broadcast(duplicate_clusters(items).agg(F.count("*").alias("duplicate_cluster_count"))))


def quality_signals(items: DataFrame) -> DataFrame:
    """(signal, id): stability out of range, times that can't be read (one row each field), garbled text that isn't archived."""
    out = items.filter(~F.col("stability").between(0, 1)).select(F.lit("invalid_stability").alias("signal"), "id")
    for c in ("created_at", "last_seen_at", "reviewed_at"):
        if c in items.columns:
            out = out.unionByName(items.filter(normalize(F.col(c).cast("string"))["error"].isNotNull()).select(F.lit(f"invalid_{c}").alias("signal"), "id"))
    garbled = is_garbled("title") | is_garbled("summary") | is_garbled("details")
    return out.unionByName(items.filter(garbled & (F.col("status") != "archived")).select(F.lit("garbled").alias("signal"), "id"))


def repair(items: DataFrame, times: tuple[str, ...] = ("created_at", "last_seen_at", "reviewed_at")) -> tuple[DataFrame, DataFrame]:
    """(items, changes): garbled text that was overridden by hand is archived, other garbled text goes, stability is
    held within 0..1 and times are normalised. changes: id, kind, field, before, after; skipped times have kind skipped."""
    garbled = is_garbled("title") | is_garbled("summary") | is_garbled("details")
    rows = items.withColumn("_bad", garbled).withColumn("_stable", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "stability")))
    for c in times:
        rows = rows.withColumn(f"_{c}", normalize(F.col(c).cast("string")))
    change = lambda kind, field, before, after: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"))
    none = F.lit(None).cast("string")
    log = [
        F.when(F.col("_bad") & F.col("manual_override"), change("garbled_manual_archived", "status", F.col("status"), F.lit("archived"))),
        F.when(F.col("_bad") & ~F.col("manual_override"), change("garbled_system_removed", "status", F.col("status"), none)),
        F.when((~F.col("_bad") | F.col("manual_override")) & (F.col("_stable") != F.col("stability")), change("stability_clamped", "stability", F.col("stability"), F.col("_stable"))),
    ]
    for c in times:
        log.append(F.when(F.col(f"_{c}.changed"), change("timestamp_normalized", c, F.col(c), F.col(f"_{c}.value"))))
        log.append(F.when(F.col(f"_{c}.error").isNotNull(), F.struct(F.lit("skipped").alias("kind"), F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), F.col(f"_{c}.error").alias("after"))))
    changes = rows.select("id", F.explode(F.array_compact(F.array(*log))).alias("c")).select("id", "c.*")
    fixed = rows.filter(~F.col("_bad") | F.col("manual_override")).withColumn("status", F.when(F.col("_bad"), "archived").otherwise(F.col("status"))).withColumn("stability", F.col("_stable"))
    for c in times:
        fixed = fixed.withColumn(c, F.col(f"_{c}.value"))
    return fixed.select(*items.columns), changes


def tag_contradictions(items: DataFrame, positive: Sequence[str] = V.POSITIVE, negative: Sequence[str] = V.NEGATIVE) -> DataFrame:
    """items, those tagged `potential-conflict` that may contradict another: active profile or procedural memories of one
    type and scope whose titles share a word and of which one asks for what the other forbids. Where no model judges
    pairs, polarity does. Both sides meet by word as counts, so no pairs are made."""
    judged = items.filter((F.col("status") == "active") & F.col("memory_type").isin("profile", "procedural")).select("id", "memory_type", "scope", F.explode(token_set("title")).alias("word"), polarity(F.concat_ws(" ", "summary", "details"), positive, negative).alias("p")).filter("p <> 0")
    keys = ["memory_type", "scope", "word"]
    both = judged.groupBy(*keys).agg(F.min("p").alias("low"), F.max("p").alias("high")).filter("low < high").select(*keys)
    ids = judged.join(both, keys, "left_semi").select("id").distinct().withColumn("_conflict", F.lit(True))
    tags = F.when(F.col("_conflict"), F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("potential-conflict"))))).otherwise(F.col("tags"))
    return items.join(ids, "id", "left").withColumn("tags", tags).drop("_conflict")


ACTIONS = ("promote", "confirm", "demote", "archive", "contradict", "merge")


def apply_reviews(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """items after reviews (id, action, target_id, reviewed_at), the latest of each id counting: promote and confirm make
    active and lift confidence to 0.9 and stability to 0.85 at least, demote makes a candidate, archive, contradict (with
    its target, if any) and merge (needs a target) end a memory; all mark it as overridden and reviewed."""
    last = reviews.filter(F.col("action").isin(*ACTIONS) & ((F.col("action") != "merge") | F.col("target_id").isNotNull())).groupBy("id").agg(F.max_by(F.struct("action", "target_id", "reviewed_at"), F.struct("reviewed_at", "action")).alias("r"))
    rows = items.join(last, "id", "left")
    act = F.col("r.action")
    up = act.isin("promote", "confirm")
    status = F.when(up, "active").when(act == "demote", "candidate").when(act == "contradict", "contradicted").when(act.isin("archive", "merge"), "archived").otherwise(F.col("status"))
    return (
        rows.withColumn("status", status)
        .withColumn("confidence", F.when(up, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")))
        .withColumn("stability", F.when(up, F.greatest("stability", F.lit(0.85))).otherwise(F.col("stability")))
        .withColumn("manual_override", F.when(act.isNotNull(), True).otherwise(F.col("manual_override")))
        .withColumn("supersedes", F.when(act.isin("contradict", "merge"), F.col("r.target_id")))
        .withColumn("reviewed_at", F.col("r.reviewed_at"))
        .drop("r")
    )


def select_for_review(items: DataFrame, as_of: Column, min_confidence: float | None = None, older_than_days: int | None = None, status: str = "candidate") -> DataFrame:
    """Items of a status, sure or old enough, for one action on all of them."""
    rows = items.filter(F.col("status") == status)
    if min_confidence is not None:
        rows = rows.filter(F.col("confidence") >= min_confidence)
    if older_than_days is not None:
        rows = rows.filter(whole_days("created_at", as_of) >= older_than_days)
    return rows


def expired(items: DataFrame, as_of: Column) -> DataFrame:
    """Items older than their days allow, whole days counting."""
    return items.filter(whole_days("created_at", as_of) > F.coalesce("expiration_days", F.lit(90)))
