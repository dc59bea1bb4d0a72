"""Pages of digests, skills and profiles, and what a skill's record says where it says nothing."""

from pyspark.sql import functions as F

from recollect.operators import records, wiki


def test_digest_pages(spark):
    code = "array<struct<lang:string,code:string>>"
    schema = f"id string, title string, category string, source_tool string, created_at string, message_count long, related_project string, summary string, insights array<string>, key_decisions array<string>, fragments array<string>, code {code}, follow_ups array<string>, related_memory_ids array<string>, tags array<string>"
    rows = [
        ("a", "T", "debug", "codex", "2024-01-01", 3, "p", "s", ["i1", "i2"], ["d"], ["c1", "c2"], [("py", "x = 1")], ["q"], ["m1"], ["t", "u"]),
        ("b", "U", "other", "codex", None, 0, None, None, None, [], None, None, None, None, None),
    ]
    got = {r.id: r.content for r in records.digest_pages(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"] == (
        "# T\n\n**类别**: debug\n**工具**: codex\n**生成时间**: 2024-01-01\n**消息数**: 3\n**项目**: p\n\n**摘要**: s\n\n## 核心洞见\n1. i1\n2. i2\n\n## 关键决策\n- d\n\n"
        "## 知识碎片\n### 1. c1\n```py\nx = 1\n```\n\n### 2. c2\n\n\n## 待探索问题\n- q\n\n## 关联记忆\n- [[m1]]\n\n**标签**: t, u\n"
    )
    assert got["b"] == "# U\n\n**类别**: other\n**工具**: codex\n**生成时间**: \n**消息数**: 0\n"


def test_skills_as_read_and_their_pages(spark):
    rows = [("a", "N", "T", "D", ["one", "two"], 1.7, 8, 1), ("b", None, "T", "D", None, None, None, None), ("c", "N", "T", "D", None, -3.0, None, None)]
    read = records.with_skill_defaults(spark.createDataFrame(rows, "id string, name string, trigger string, description string, steps array<string>, confidence double, usage_count long, success_count long"), F.lit("2024-01-01"))
    held = {r.id: r for r in read.collect()}
    assert set(held) == {"a", "c"} and (held["a"].confidence, held["c"].confidence) == (1.0, 0.0)
    assert (held["c"].status, held["c"].version, held["c"].steps, held["c"].manual_override, held["c"].created_at, held["c"].source_task_type) == ("draft", 1, [], False, "2024-01-01", "general")
    rich = read.withColumn("examples", F.expr("array(named_struct('description', 'e', 'input_text', 'in', 'expected_result', cast(null as string)))")).withColumn("expected_outputs", F.expr("array(cast(null as string), 'out')")).withColumn("tools_required", F.array(F.lit("git")))
    got = {r.id: r.content for r in records.skill_pages(rich).collect()}
    assert got["a"] == "# N\n\n**描述**: D\n**触发条件**: T\n\n**所需工具**: git\n\n## 执行步骤\n1. one\n2. two\n   - 期望输出: out\n\n## 使用示例\n### 示例 1: e\n**输入**: in\n\n---\n*技能版本: 1 | 使用次数: 8 | 成功率: 12%*\n"
    plain = {r.id: r.content for r in records.skill_pages(read).collect()}
    assert plain["c"] == "# N\n\n**描述**: D\n**触发条件**: T\n\n---\n*技能版本: 1 | 使用次数: 0 | 成功率: 0%*\n"


def test_profile_pages(spark):
    base = spark.createDataFrame([("u", "dev", ["sql", "io"], 0.995, "2024-05-01", [f"p{i}" for i in range(12)])], "user string, role string, expertise array<string>, confidence double, last_updated string, project_history array<string>")
    full = base.withColumn("tools", F.expr("array(named_struct('tool', 'a', 'count', 1L), named_struct('tool', 'b', 'count', 9L))")).withColumn("growth", F.expr("array(named_struct('at', '2024-04-01T00', 'milestone', 'm', 'skill_added', 's'))")).withColumn("cycles", F.lit(7).cast("long"))
    got = records.profile_pages(full).first().content
    assert got.startswith("# 用户画像\n\n**版本**: 1 | **置信度**: 100%\n**最后更新**: 2024-05-01\n**辩证循环次数**: 7\n\n**角色**: dev\n**专业领域**: sql, io\n\n## 工具使用频率\n- b: 9 次\n- a: 1 次\n\n## 项目经历 (12 个)\n- p2\n")
    assert got.endswith("## 成长轨迹\n- [2024-04-01] m\n  - 新增技能: s\n")


def test_full_lint_report(spark):
    rows = [
        ("m1", "Use python logging", "always log", "project", "p", "semantic", ["logging"]),
        ("m2", "Skip python logging", "never log", "project", "p", "semantic", ["logging"]),
        ("m3", "Use python logging", "always log", "project", "p", "semantic", ["other"]),
        ("m4", "Use python loggings", "always log", "project", None, "semantic", ["x"]),
    ]
    m = spark.createDataFrame([(*r, 0.9, 0.8, "", None) for r in rows], "id string, title string, summary string, scope string, project_key string, memory_type string, tags array<string>, confidence double, stability double, details string, evidence array<struct<excerpt:string>>")
    got = wiki.full_lint_report(m).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.issue_type, []).append((r.subject, r.other, r.page_key, r.samples))
    assert len(kinds["weak_evidence"]) == 4 and kinds["missing_project_key"][0][0] == "m4"
    assert kinds["conflicting_topic"] == [("logging", "p", "topics/logging", ["Use python logging", "Skip python logging"])]
    assert ("m1", "m3", "projects/p/index", ["Use python logging", "Use python logging"]) in kinds["duplicate_concept"]
    front = {r.page_key: r.content for r in wiki.front_pages(m, wiki.full_lint_report(m)).collect()}
    assert "- Topic `logging` has conflicting guidance inside project `p`.\n  Samples: Use python logging, Skip python logging\n  Suggested action: Review these memories" in front["health"]
