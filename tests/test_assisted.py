"""Model calls that are kept, and what is made of their answers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from recollect.functions import providers
from recollect.operators import assisted, digest, distill, lifecycle


def counting(folder, answer, fails=()):
    """A model that notes every call in a folder; calls whose number is in `fails` end the task."""

    def model(texts):
        n = len(os.listdir(folder))
        (folder / f"{n:04}-{os.getpid()}").write_text(str(len(texts)))
        if n in fails:
            raise SystemExit(1)
        return [answer(t) for t in texts]

    return model


def calls(folder):
    return [int(p.read_text()) for p in sorted(folder.iterdir())]


def test_answers_are_kept_and_nobody_is_called_twice(spark, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()
    prompts = spark.range(100).select(F.concat(F.lit("p"), (F.col("id") % 60).cast("string")).alias("prompt")).unionByName(spark.createDataFrame([("",), (None,)], "prompt string")).coalesce(1)
    store = f"file://{tmp_path}/store"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with pytest.raises(Exception):
            providers.answers(prompts, store, counting(seen, str.upper, fails={2}), batch=3).collect()
        assert calls(seen) == [10, 10, 10]  # the third call ended the task, two batches are kept
        got = {r.answer for r in providers.answers(prompts, store, counting(seen, str.upper), batch=3).collect()}
        assert got == {f"P{i}" for i in range(60)} and sum(calls(seen)[3:]) == 40
        before = len(calls(seen))
        again = providers.answers(prompts, store, counting(seen, str.upper), batch=3)
        assert again.count() == 60 and again.filter("answer is null").isEmpty() and len(calls(seen)) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_failing_and_empty_answers_fall_back(spark, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()

    def moody(texts):
        (seen / f"{len(os.listdir(seen)):04}").write_text(str(len(texts)))
        if len(os.listdir(seen)) == 1:
            raise ValueError("busy")
        return [None if t == "a" else " " if t == "b" else t * 2 for t in texts]

    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "t string, answer int").coalesce(1)
    got = providers.answered(df, F.col("t"), "said", F.lit("rules"), moody, wait=0.01)
    assert sorted((r.answer, r.said) for r in got.collect()) == [(1, "rules"), (2, "rules"), (3, "cc"), (4, "rules")]
    assert len(calls(seen)) >= 2
    plain = providers.answered(df, F.col("t"), "said", F.lit("rules"))
    assert {r.said for r in plain.collect()} == {"rules"}

    def broken(texts):
        raise ValueError

    assert {r.said for r in providers.answered(df, F.col("t"), "said", F.lit("rules"), broken, retries=2, wait=0.01).collect()} == {"rules"}


EVENTS = "id string, source_tool string, source_path string, session_id string, timestamp string, role string, project_key string, text string, line_no int"


def events(spark, n=60):
    rows = [(f"e{i:03}", "codex", "f", f"s{i // 10}", f"2024-01-01T00:{i:02}:00+00:00", ("user", "assistant")[i % 2], None, f"message {i} about thing{i % 4} we decide to use it", i) for i in range(n)]
    return spark.createDataFrame(rows, EVENTS)


def test_digests_of_a_model_and_of_rules(spark):
    def model(texts):
        made = json.dumps({"title": "T" * 80, "category": "debug", "summary": "s", "insights": [f"i{k}" for k in range(9)], "sparks": [{"content": "c"}], "follow_ups": ["q", " "], "key_decisions": []})
        return [f"Here:\n```json\n{made}\n```" if "message 3 " in t else "no idea" for t in texts]

    ev = events(spark)
    got = {r.chunk_id: r for r in assisted.model_digests(ev, model).collect()}
    plain = {r.chunk_id: r for r in digest.digests(ev).collect()}
    assert got.keys() == plain.keys() and [k for k, r in got.items() if r.made_by == "model"] == ["s0-chunk-0"]
    one = got["s0-chunk-0"]
    assert (one.title, one.category, one.summary, one.insights, one.follow_ups, one.key_decisions, one.fragments) == ("T" * 60, "debug", "s", [f"i{k}" for k in range(5)], ["q"], [], ["c"])
    assert all(got[k].title == plain[k].title and got[k].insights == plain[k].insights for k in plain if k != "s0-chunk-0")
    assert {r.made_by for r in assisted.model_digests(ev).collect()} == {"rules"}


def test_memories_of_a_model(spark):
    def model(texts):
        out = []
        for t in texts:
            sure = {"title": "Thing1", "memory_type": "procedural", "scope": "global", "summary": "use thing1", "confidence": 0.9, "stability": 0.8, "tags": ["b", "a"]}
            weak = {"title": "other", "memory_type": "profile", "scope": "global", "summary": "says: message 2 about thing2 we decide to use it", "hints": "h", "confidence": 3, "stability": 0.8}
            bad = {"title": "", "memory_type": "procedural", "scope": "global", "summary": "x", "confidence": 1, "stability": 1}
            out.append(json.dumps({"memories": [sure, weak, bad, {"title": "k", "memory_type": "unknown"}]}) if "message 0 " in t else "{}")
        return out

    ev = events(spark, 60)
    got = {r.title: r for r in assisted.model_memories(ev, model, batch=3).collect()}
    assert set(got) == {"Thing1", "other"}
    assert (got["Thing1"].status, got["Thing1"].tags, got["Thing1"].details) == ("active", ["a", "b", "procedural"], "use thing1")
    assert [e.source_path for e in got["Thing1"].evidence] == ["llm_batch"] and got["Thing1"].evidence[0].excerpt == "use thing1"
    assert (got["other"].status, got["other"].confidence, got["other"].tags) == ("candidate", 1.0, ["needs-review", "profile"])
    assert [e.excerpt for e in got["other"].evidence] == ["message 2 about thing2 we decide to use it"] and got["other"].evidence[0].source_tool == "codex"
    rules = {"keywords": ("decide",)}
    want = {r.id for r in distill.consolidate(ev, **rules).collect()}
    assert want and {r.id for r in assisted.model_memories(ev, lambda ts: ["nothing"] * len(ts), **rules).collect()} == want
    assert {r.id for r in assisted.model_memories(ev, **rules).collect()} == want
    assert assisted.model_memories(ev, lambda ts: ["nothing"] * len(ts), fallback=False).count() == 0


def test_steps_of_a_model(spark):
    skills = spark.createDataFrame([(i, f"n{i}", "t", "d", ["one"], 1, 0, False) for i in range(3)], "id int, name string, trigger string, description string, steps array<string>, version int, improvement_count int, manual_override boolean")
    feedback = spark.createDataFrame([(0, k, k % 2 == 0, f"note {k}") for k in range(30)] + [(1, 5, False, "x" * 200)], "id int, at int, success boolean, notes string")
    seen = []

    def model(texts):
        return ['{"steps": ["new", " "]}' if "note 29" in t and "note 11" in t and "note 9" not in t.replace("note 29", "") else "{}" for t in texts]

    made = assisted.model_steps(skills, feedback, model)
    got = {r.id: r for r in made.collect()}
    assert got[0].steps == ["new"] and got[0]["at"] == 29 and got[1].steps == ["one", "[改进] 根据反馈补充: " + "x" * 100] and 2 not in got
    better = {r.id: (r.steps, r.version) for r in lifecycle.improved_skills(skills, made).collect()}
    assert better == {0: (["new"], 2), 1: (["one", "[改进] 根据反馈补充: " + "x" * 100], 2), 2: (["one"], 1)} and not seen
    assert {r.id: r.steps[-1] for r in assisted.model_steps(skills, feedback).collect()}[0] == "[改进] 根据反馈补充: note 29"


def test_profiles(spark, monkeypatch):
    import random

    rng = random.Random(4)
    monkeypatch.setattr(lifecycle, "FOLD", 7)
    rounds = [(u, i, rng.random() < p) for u, p in (("a", 0.2), ("b", 0.5), ("c", 0.9)) for i in range(900)] + [("d", 0, True)]
    want = {}
    for u, _, up in rounds:
        c = want.setdefault(u, 0.5)
        want[u] = min(0.99, c + 0.05) if up else max(0.1, c - 0.02)
    log = spark.createDataFrame(rng.sample(rounds, len(rounds)), "user string, at int, up boolean")
    got = {r.user: (r.cycles, r.confidence) for r in lifecycle.profile_confidence(log, "user", F.col("at"), F.col("up")).collect()}
    assert {u: c for u, (c, _) in got.items()} == {"a": 900, "b": 900, "c": 900, "d": 1}
    assert all(abs(got[u][1] - want[u]) < 1e-9 for u in want)
    kept = spark.createDataFrame([("a", "session", 1, None), ("a", "session", 4, None), ("a", "skill", 3, "deploy"), ("a", "context", 2, None), ("b", "task", 9, None)], "user string, kind string, at int, name string")
    counts = {r.user: tuple(r)[1:] for r in lifecycle.profile_counters(kept, "user", "kind", "at").collect()}
    assert counts == {"a": (2, 0, 1, 2, 4), "b": (0, 1, 0, None, 9)}
    assert [tuple(r) for r in lifecycle.growth_entries(kept, "user", "kind", "at", "name").collect()] == [("a", 3, "创建新技能: deploy", "skill creation", "deploy")]


def test_what_profiles_dont_know_yet(spark):
    items = spark.createDataFrame([(i, f"t{i}", "active", "global", "shared", None, 0.9 - i / 100, 0.5, ["spark", "io", "sql"] if i < 20 else ["late"], None, None) for i in range(25)], "id int, title string, status string, scope string, tool string, project_key string, confidence double, stability double, tags array<string>, last_seen_at timestamp, created_at timestamp")
    skills = spark.createDataFrame([(1, "deploy", "active", ["git", "bash"], 4, 1), (2, "ok", "active", ["bash", "awk", "sed"], 4, 4), (3, "gone", "archived", ["vi"], 9, 0)], "id int, name string, status string, tools_required array<string>, usage_count int, success_count int")
    profiles = spark.createDataFrame([("a", ["sql"], ["jvm"], ["bash"]), ("b", ["spark", "sql"], None, ["awk", "bash", "git", "sed"]), ("c", None, None, None)], "user string, expertise array<string>, technology_stack array<string>, tools array<string>")
    got = {r.user: r for r in lifecycle.inferred_dialectic(profiles, items, skills).collect()}
    assert got["a"].thesis == "现有专业领域: sql | 技术栈: jvm"
    assert got["a"].antithesis == "新发现领域: spark | 新使用工具: awk, git, sed | 成功率低的技能: deploy"
    assert got["a"].synthesis == "扩展专业领域: 新增 spark ; 工具偏好进化: 尝试使用 awk, git, sed ; 技能优化: 改进 deploy 的执行策略"
    assert got["b"].antithesis == "成功率低的技能: deploy" and got["c"].thesis == "现有画像未记录显著偏好"
    assert lifecycle.inferred_dialectic(profiles.filter("user = 'b'"), items, skills.filter("id > 1")).count() == 0


def test_contradictions_of_a_model(spark):
    rows = [(i, f"t{i}", "s", "procedural" if i < 6 else "semantic", "global", ["b"] if i % 2 else None) for i in range(8)]
    items = spark.createDataFrame(rows, "id int, title string, summary string, memory_type string, scope string, tags array<string>")
    pairs = spark.createDataFrame([(0, 1), (0, 1), (2, 3), (4, 5), (6, 7), (5, 6)], "first_id int, second_id int")

    def model(texts):
        return ['{"contradicts": true, "reason": "r"}' if "t1 " in t else '{"contradicts": false}' if "t3 " in t else "perhaps" for t in texts]

    found = assisted.model_contradictions(pairs, items, model)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, "r"), (4, 5, "rule")]
    assert sorted((r.first_id, r.second_id) for r in assisted.model_contradictions(pairs, items).collect()) == [(0, 1), (2, 3), (4, 5)]
    tags = {r.id: r.tags for r in assisted.with_conflict_tags(items, found).collect()}
    assert tags[0] == ["potential-conflict"] and tags[1] == ["b", "potential-conflict"] and tags[2] is None and tags[3] == ["b"]
