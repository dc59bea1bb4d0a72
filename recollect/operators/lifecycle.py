"""How skills and profiles change: reviews, improvements and counters, each from an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered
from .search import list_memories


def reviewed_skills(skills: DataFrame, reviews: DataFrame) -> DataFrame:
    """skills with the status that their reviews (id, action, at) lead to.

    promote makes an active skill of a draft, demote a draft of an active one, archive ends a skill; what doesn't fit the
    status does nothing. So an archived skill stays one, and otherwise the last promotion or demotion decides: one
    minimum and one maximum for each skill, whatever the length of the log.
    """
    moves = F.when(F.col("action").isin("promote", "demote"), F.struct("at", "action"))
    last = reviews.groupBy("id").agg(F.bool_or(F.col("action") == "archive").alias("_ended"), F.max(moves).alias("_move"))
    rows = skills.join(last, "id", "left")
    status = F.when((F.col("status") == "archived") | F.col("_ended"), "archived").when(F.col("_move.action") == "promote", "active").when(F.col("_move.action") == "demote", "draft").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_ended", "_move")


def improved_skills(skills: DataFrame, improvements: DataFrame) -> DataFrame:
    """skills (id, steps, version, improvement_count, manual_override) after their improvements (id, at, steps): each adds one
    to version and count and marks the skill as overridden; the last steps that aren't null take the place of the old."""
    made = improvements.groupBy("id").agg(F.count("*").alias("_n"), F.max_by("steps", F.when(F.col("steps").isNotNull(), F.col("at"))).alias("_steps"))
    n = F.coalesce("_n", F.lit(0))
    rows = skills.join(made, "id", "left").withColumn("steps", F.coalesce("_steps", "steps")).withColumn("version", F.col("version") + n)
    return rows.withColumn("improvement_count", F.col("improvement_count") + n).withColumn("manual_override", F.col("manual_override") | (n > 0)).drop("_n", "_steps")


def tag_counts(skills: DataFrame) -> DataFrame:
    """(tag, count) of active skills."""
    return skills.filter(F.col("status") == "active").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def tool_preferences(log: DataFrame, user: str, tool: str) -> DataFrame:
    """(user, tool, count, place): tools of each user, most used first, then by name."""
    counts = log.groupBy(user, tool).agg(F.count("*").alias("count"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("count"), tool)))


#: Rounds in a part, and parts in a part of parts.
FOLD = 1024
#: Confidence in hundredths: its bounds, and what a round with and without a longer synthesis adds.
LEAST, MOST, UP, DOWN = 10, 99, 5, -2


def profile_confidence(log: DataFrame, user: str, order: Column, longer: Column, start: float = 0.5) -> DataFrame:
    """(user, cycles, confidence) after each user's rounds of thesis and synthesis in their order: 0.05 more, up to 0.99,
    where the synthesis is longer, else 0.02 less, down to 0.1.

    Sums that stop at bounds depend on their order, but several rounds in a row do to a number what one step does that
    adds a shift and then stops at bounds of its own, and two such steps make one again. So rounds are numbered, FOLD of
    them become one step, FOLD steps one, and so on (four times, which is enough for any user): no list is longer.
    """
    rounds = log.select(F.col(user), order.alias("_o"), longer.alias("_up"))
    rounds = numbered(rounds, [user], ["_o", "_up"], "_n").withColumn("_n", F.col("_n") - 1)
    step = F.when(F.col("_up"), F.struct(F.lit(-(1 << 40)).alias("low"), F.lit(MOST).cast("long").alias("high"), F.lit(UP).cast("long").alias("shift")))
    step = step.otherwise(F.struct(F.lit(LEAST).cast("long").alias("low"), F.lit(1 << 40).alias("high"), F.lit(DOWN).cast("long").alias("shift")))
    parts = rounds.select(user, "_n", step.alias("f"), F.lit(1).cast("long").alias("c"))
    same = F.struct(F.lit(-(1 << 40)).alias("low"), F.lit(1 << 40).alias("high"), F.lit(0).cast("long").alias("shift"))
    within = lambda x, f: F.least(f["high"], F.greatest(f["low"], x + f["shift"]))
    then = lambda f, g: F.struct(within(f["low"], g).alias("low"), within(f["high"], g).alias("high"), (f["shift"] + g["shift"]).alias("shift"))
    for _ in range(4):
        held = parts.groupBy(user, F.floor(F.col("_n") / FOLD).alias("_n")).agg(F.array_sort(F.collect_list(F.struct("_n", "f"))).alias("r"), F.sum("c").alias("c"))
        parts = held.select(user, "_n", F.aggregate("r", same, lambda s, x: then(s, x["f"])).alias("f"), "c")
    return parts.select(user, F.col("c").alias("cycles"), (within(F.lit(round(start * 100)).cast("long"), F.col("f")) / 100.0).alias("confidence"))


def profile_counters(log: DataFrame, user: str, kind: str, at: str) -> DataFrame:
    """(user, total_sessions, total_tasks_completed, total_skills_created, last_context_used, last_updated) out of a log of
    what was recorded: kinds session, task, skill, context, tool; each counts, and any of them is an update."""
    of = lambda k: F.col(kind) == k
    counts = [F.count_if(of(k)).alias(n) for k, n in (("session", "total_sessions"), ("task", "total_tasks_completed"), ("skill", "total_skills_created"))]
    return log.groupBy(user).agg(*counts, F.max(F.when(of("context"), F.col(at))).alias("last_context_used"), F.max(at).alias("last_updated"))


def growth_entries(log: DataFrame, user: str, kind: str, at: str, name: str) -> DataFrame:
    """(user, at, milestone, evidence, skill_added): an entry for each skill that a user made."""
    made = log.filter(F.col(kind) == "skill")
    return made.select(user, F.col(at).alias("at"), F.concat(F.lit("创建新技能: "), name).alias("milestone"), F.lit("skill creation").alias("evidence"), F.col(name).alias("skill_added"))


def inferred_dialectic(profiles: DataFrame, items: DataFrame, skills: DataFrame, listed: int = 20) -> DataFrame:
    """(user, thesis, antithesis, synthesis, trigger) of the profiles (user, expertise, technology_stack, tools) for which
    memories or skills have something new; others have no row.

    The thesis is what a profile knows; the antithesis the tags (over two characters) of the first `listed` active
    memories and the tools of active skills that it doesn't know, and the first skills that fail more often than not; the
    synthesis takes the first of them up. New things are in the order of their names. Tags come from `listed` rows, and
    tools and names are cut to what a profile can show before they are gathered.
    """
    none = F.array().cast("array<string>")
    known = profiles.select("user", *(F.coalesce(c, none).alias(c) for c in ("expertise", "technology_stack", "tools")))
    tags = list_memories(items, listed, status="active").select(F.explode("tags").alias("tag")).filter(F.length("tag") > 2).agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
    active = skills.filter("status = 'active'")
    # the first five that a profile doesn't know are among as many as it knows and five more, in the order of names
    most = (known.agg(F.max(F.size("tools"))).first()[0] or 0) + 5
    tools = active.select(F.explode("tools_required").alias("tool")).distinct().orderBy("tool").limit(most).agg(F.array_sort(F.collect_list("tool")).alias("_tools"))
    failing = active.filter((F.col("usage_count") >= 3) & (F.try_divide(F.col("success_count"), F.col("usage_count")) < 0.5)).orderBy("name", "id").limit(3).agg(F.array_sort(F.collect_list("name")).alias("_failing"))
    rows = known.join(F.broadcast(tags)).join(F.broadcast(failing)).join(F.broadcast(tools))
    rows = rows.withColumn("_new_tags", F.array_except("_tags", "expertise")).withColumn("_new_tools", F.array_except("_tools", "tools"))
    said = lambda label, names, most: F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(F.slice(names, 1, most), ", ")))
    thesis = F.concat_ws(" | ", said("现有专业领域: ", F.col("expertise"), 3), said("技术栈: ", F.col("technology_stack"), 3))
    antithesis = F.concat_ws(" | ", said("新发现领域: ", F.col("_new_tags"), 5), said("新使用工具: ", F.col("_new_tools"), 5), said("成功率低的技能: ", F.col("_failing"), 3))
    improved = F.when(F.size("_failing") > 0, F.concat(F.lit("技能优化: 改进 "), F.array_join(F.slice("_failing", 1, 2), ", "), F.lit(" 的执行策略")))
    synthesis = F.concat_ws(" ; ", said("扩展专业领域: 新增 ", F.col("_new_tags"), 3), said("工具偏好进化: 尝试使用 ", F.col("_new_tools"), 3), improved)
    shown = F.when(thesis == "", "现有画像未记录显著偏好").otherwise(thesis)
    return rows.select("user", shown.alias("thesis"), antithesis.alias("antithesis"), synthesis.alias("synthesis"), F.lit("auto-inferred from memories and skills").alias("trigger")).filter("antithesis <> ''")
