"""Digests, skills and profiles as records: defaults and bounds when they are read, and their pages in Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "array<string>"


def _of(df: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def _list(c: Column, kind: str = NONE) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _said(label: str, value: Column) -> Column:
    """A line with a label; null where there is nothing to say."""
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f"**{label}**: "), value.cast("string")))


def _section(heading: str, items: Column, line: Callable[[Column, Column], Column], before: str = "\n", after: str = "") -> Column:
    """A heading and a line for each item; null where there are none."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{before}## {heading}\n"), F.array_join(F.transform(items, line), "\n"), F.lit(after)))


def _bullet(x: Column, _: Column) -> Column:
    return F.concat(F.lit("- "), x)


def _numbered(x: Column, i: Column) -> Column:
    return F.concat((i + 1).cast("string"), F.lit(". "), x)


def _text(*parts: Column) -> Column:
    """Parts that aren't null, a line each, without blank lines at the end."""
    return F.concat(F.regexp_replace(F.array_join(F.array_compact(F.array(*parts)), "\n"), r"\s+$", ""), F.lit("\n"))


def _percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def digest_pages(digests: DataFrame) -> DataFrame:
    """(id, content): a page for each digest: what it is, then insights, decisions, fragments with their code, questions, memories and tags, as far as there are any.

    Columns that a table lacks are left out of the page. `code` holds the code of each fragment, in their order.
    """
    tools = _of(digests, "participant_tools", NONE)
    sparks = _fragments(digests)
    summary = _said("摘要", F.col("summary"))
    tags = _list(_of(digests, "tags", NONE))
    page = _text(
        F.concat(F.lit("# "), "title", F.lit("\n")),
        _said("类别", F.col("category")),
        F.concat(F.lit("**工具**: "), F.when(F.size(tools) > 0, F.array_join(tools, ", ")).otherwise(F.coalesce("source_tool", F.lit("")))),
        F.concat(F.lit("**生成时间**: "), F.coalesce(F.col("created_at").cast("string"), F.lit(""))),
        F.concat(F.lit("**消息数**: "), F.col("message_count").cast("string")),
        _said("项目", _of(digests, "related_project")),
        F.when(summary.isNotNull(), F.concat(F.lit("\n"), summary)),
        _section("核心洞见", _list(F.col("insights")), _numbered),
        _section("关键决策", _list(F.col("key_decisions")), _bullet),
        _section("知识碎片", sparks, _spark),
        _section("待探索问题", _list(F.col("follow_ups")), _bullet),
        _section("关联记忆", _list(_of(digests, "related_memory_ids", NONE)), lambda x, _: F.concat(F.lit("- [["), x, F.lit("]]"))),
        F.when(F.size(tags) > 0, F.concat(F.lit("\n**标签**: "), F.array_join(tags, ", "))),
    )
    return digests.select("id", page.alias("content"))


def _spark(x: Column, i: Column) -> Column:
    """A fragment with its code, under a number."""
    shown = F.when(F.coalesce(x["code"]["code"], F.lit("")) != "", F.concat(F.lit("\n```"), F.coalesce(x["code"]["lang"], F.lit("")), F.lit("\n"), x["code"]["code"], F.lit("\n```"))).otherwise("")
    return F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), F.coalesce(x["content"], F.lit("")), shown, F.lit("\n"))


def _fragments(digests: DataFrame) -> Column:
    kind = "array<struct<lang:string,code:string>>"
    return F.arrays_zip(_list(_of(digests, "fragments", NONE)).alias("content"), _list(_of(digests, "code", kind), kind).alias("code"))


def brainstorm_pages(digests: DataFrame) -> DataFrame:
    """(path, content) for the folder of ideas: a page for each active digest, one with its reasoning where it has decisions or fragments, and one for each open question."""
    active = digests.filter(F.col("status") == "active")
    made = F.concat(F.lit("**生成时间**: "), F.coalesce(F.col("created_at").cast("string"), F.lit("")))
    plain = digest_pages(active).select(F.concat(F.lit("dreams/"), "id", F.lit(".md")).alias("path"), "content")
    decisions, sparks = _list(F.col("key_decisions")), _fragments(active)
    section = lambda heading, items, line: F.when(F.size(items) > 0, F.concat(F.lit(f"## {heading}\n\n"), F.array_join(F.transform(items, line), "\n"), F.lit("\n")))
    reasons = F.concat_ws("\n", F.concat(F.lit("# "), "title", F.lit(" - 推理过程\n")), F.concat(made, F.lit("\n")), section("关键决策", decisions, _numbered), section("知识碎片", sparks, _spark))
    thought = active.filter((F.size(decisions) > 0) | (F.size(sparks) > 0)).select(F.concat(F.lit("dreams/"), "id", F.lit("-reasoning.md")).alias("path"), reasons.alias("content"))
    asked = active.select("id", "title", made.alias("_made"), F.posexplode("follow_ups").alias("_n", "question"))
    source = F.concat(F.lit("**来源 Dream**: ["), "title", F.lit("](dreams/"), "id", F.lit(".md)"))
    text = F.concat_ws("\n", F.lit("# 待探索问题\n"), source, "_made", F.lit("**状态**: 待探索\n\n## 问题\n"), F.concat("question", F.lit("\n")), F.lit("## 探索记录\n\n_在此记录探索过程和结论..._"))
    open_ = asked.select(F.concat(F.lit("questions/"), "id", F.lit("-q"), (F.col("_n") + 1).cast("string"), F.lit(".md")).alias("path"), text.alias("content"))
    return plain.unionByName(thought).unionByName(open_)


def skill_pages(skills: DataFrame) -> DataFrame:
    """(id, content): a page for each skill (with_skill_defaults): what it is for, tags, tools, steps, examples, and how it did."""
    outputs, needs = _list(_of(skills, "expected_outputs", NONE)), _of(skills, "step_tools", "array<array<string>>")

    def step(x: Column, i: Column) -> Column:
        output, tools = F.get(outputs, i), F.get(needs, i)
        first = F.when(F.coalesce(output, F.lit("")) != "", F.concat(F.lit("\n   - 期望输出: "), output)).otherwise("")
        return F.concat(_numbered(x, i), first, F.when(F.size(tools) > 0, F.concat(F.lit("\n   - 工具: "), F.array_join(tools, ", "))).otherwise(""))

    kind = "array<struct<description:string,input_text:string,expected_result:string>>"

    def example(x: Column, i: Column) -> Column:
        given = [F.when(F.coalesce(x[c], F.lit("")) != "", F.concat(F.lit(f"\n**{label}**: "), x[c])).otherwise("") for label, c in (("输入", "input_text"), ("期望结果", "expected_result"))]
        return F.concat(F.lit("### 示例 "), (i + 1).cast("string"), F.lit(": "), F.coalesce(x["description"], F.lit("")), *given, F.lit("\n"))

    listed = lambda label, c: F.when(F.size(_list(F.col(c))) > 0, F.concat(F.lit(f"**{label}**: "), F.array_join(c, ", "), F.lit("\n")))
    rate = F.coalesce(F.try_divide("success_count", "usage_count"), F.lit(0.0))
    page = _text(
        F.concat(F.lit("# "), "name", F.lit("\n\n**描述**: "), F.coalesce("description", F.lit("")), F.lit("\n**触发条件**: "), F.coalesce("trigger", F.lit("")), F.lit("\n")),
        listed("标签", "tags"),
        listed("所需工具", "tools_required"),
        _section("执行步骤", _list(F.col("steps")), step, before="", after="\n"),
        _section("使用示例", _list(_of(skills, "examples", kind), kind), example, before=""),
        F.concat(F.lit("---\n*技能版本: "), F.col("version").cast("string"), F.lit(" | 使用次数: "), F.col("usage_count").cast("string"), F.lit(" | 成功率: "), _percent(rate), F.lit("*")),
    )
    return skills.select("id", page.alias("content"))


def profile_pages(profiles: DataFrame) -> DataFrame:
    """(user, content): a page for each profile: its facts, technology, tools by use, the last 10 projects and steps of growth, and the last 5 rounds.

    tools: array<struct<tool, count>>; growth: array<struct<at, milestone, skill_added>>; rounds: array<struct<cycle, thesis, antithesis, synthesis>>, each in order.
    """
    of = lambda c, kind="string": _of(profiles, c, kind)
    last = lambda c, n: F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)
    tools = _list(of("tools", "array<struct<tool:string,count:long>>"), "array<struct<tool:string,count:long>>")
    used = F.array_sort(F.transform(tools, lambda x: F.struct((-x["count"]).alias("c"), x["tool"].alias("tool"))))
    growth = _list(of("growth", "array<struct<at:string,milestone:string,skill_added:string>>"), "array<struct<at:string,milestone:string,skill_added:string>>")
    grown = lambda x, _: F.concat(F.lit("- ["), F.substring(x["at"], 1, 10), F.lit("] "), x["milestone"], F.when(F.coalesce(x["skill_added"], F.lit("")) != "", F.concat(F.lit("\n  - 新增技能: "), x["skill_added"])).otherwise(""))
    kind = "array<struct<cycle:long,thesis:string,antithesis:string,synthesis:string>>"
    rounds = _list(of("rounds", kind), kind)
    went = lambda x, _: F.concat(F.lit("- "), x["cycle"].cast("string"), F.lit(": "), F.concat_ws(" → ", x["thesis"], x["antithesis"], x["synthesis"]))
    projects = _list(of("project_history", NONE))
    cycles = F.coalesce(of("cycles", "long"), F.lit(0))
    section = lambda heading, items, line: _section(heading, items, line, before="", after="\n")
    counted = lambda heading, n, unit, body: F.when(body.isNotNull(), F.concat(F.lit(f"## {heading} ("), n.cast("string"), F.lit(f" {unit})\n"), body, F.lit("\n")))
    rows = lambda items, line: F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "\n"))
    page = _text(
        F.concat(F.lit("# 用户画像\n\n**版本**: "), F.coalesce(of("version", "int"), F.lit(1)).cast("string"), F.lit(" | **置信度**: "), _percent(F.coalesce(of("confidence", "double"), F.lit(0.5)))),
        F.concat(F.lit("**最后更新**: "), F.coalesce(of("last_updated").cast("string"), F.lit(""))),
        F.concat(F.lit("**辩证循环次数**: "), cycles.cast("string"), F.lit("\n")),
        *(_said(label, of(c)) for label, c in (("角色", "role"),)),
        _said("专业领域", F.array_join(_list(of("expertise", NONE)), ", ")),
        *(_said(label, of(c)) for label, c in (("工作风格", "working_style"), ("沟通偏好", "communication_style"), ("语言偏好", "language_preference"), ("输出格式", "output_format_preference"))),
        F.lit(""),
        section("技术栈", _list(of("technology_stack", NONE)), _bullet),
        section("工具使用频率", used, lambda x, _: F.concat(F.lit("- "), x["tool"], F.lit(": "), (-x["c"]).cast("string"), F.lit(" 次"))),
        counted("项目经历", F.size(projects), "个", rows(last(projects, 10), _bullet)),
        section("成长轨迹", last(growth, 10), grown),
        counted("辩证进化历史", cycles, "次", rows(last(rounds, 5), went)),
    )
    return profiles.select("user", page.alias("content"))


#: What a field of a skill is where a record doesn't say.
SKILL_DEFAULTS = {"source_task_type": "general", "usage_count": 0, "success_count": 0, "failure_count": 0, "version": 1, "improvement_count": 0, "status": "draft", "managed_by": "system", "manual_override": False}
SKILL_LISTS = ("steps", "tools_required", "tags", "source_dream_ids", "source_memory_ids")


def with_skill_defaults(skills: DataFrame, now: Column) -> DataFrame:
    """Skills as read: records without id, name, trigger or description are left out, what isn't said has its default, confidence (0.5) is held within 0 and 1.

    now: the time that a record without one was made.
    """
    rows = skills
    for c in ("id", "name", "trigger", "description"):
        rows = rows.filter(_of(skills, c).isNotNull())
    for c, v in SKILL_DEFAULTS.items():
        rows = rows.withColumn(c, F.coalesce(_of(skills, c, {int: "long", bool: "boolean", str: "string"}[type(v)]), F.lit(v)))
    for c in SKILL_LISTS:
        rows = rows.withColumn(c, _list(_of(skills, c, NONE)))
    confidence = F.coalesce(_of(skills, "confidence", "double").cast("double"), F.lit(0.5))
    rows = rows.withColumn("confidence", F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))
    return rows.withColumn("created_at", F.coalesce(_of(skills, "created_at").cast("string"), now.cast("string")))
