import json

from recollect.sources import transcripts as S
from recollect.streaming.ingest import land_new, read_new


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path.parent)


def test_lines_survive_what_is_wrong(spark, tmp_path):
    root = write(tmp_path / "a.jsonl", "﻿" + json.dumps({"text": "one"}), "", "{broken", {"text": "two"}, "[1]")
    got = S.lines(spark, root).orderBy("line_no").collect()
    assert [(r.line_no, json.loads(r.raw_json)["text"]) for r in got] == [(0, "one"), (3, "two")]


def test_codex_session_carries_meta_forward(spark, tmp_path):
    root = write(
        tmp_path / "s.jsonl",
        {"type": "response_item", "timestamp": "t0", "payload": {"type": "message", "role": "user", "content": [{"text": "before any"}]}},
        {"type": "session_meta", "payload": {"cwd": "/w/one", "id": "m1"}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "t", "text": "a"}, {"type": "t", "text": "b"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": "ls", "workdir": "/w/two"})}},
        {"type": "session_meta", "payload": {"cwd": "/w/three", "id": "m2"}},
        {"type": "response_item", "payload": {"type": "tool_call", "tool_name": "edit", "args": {"command": "x"}}},
        {"type": "response_item", "payload": {"type": "message", "role": "tool", "content": [{"text": "no"}]}},
    )
    got = S.codex_session(S.lines(spark, root)).orderBy("line_no").collect()
    assert [(r.event_type, r.session_id, r.cwd, r.text, r.command) for r in got] == [
        ("message", "s", None, "before any", None),
        ("message", "m1", "/w/one", "a\nb", None),
        ("tool_use", "m1", "/w/two", "shell", "ls"),
        ("tool_use", "m2", "/w/three", "edit", "x"),
    ]
    assert got[1].project_key.startswith("one-")


def test_other_parsers(spark, tmp_path):
    root = write(tmp_path / "h" / "h.jsonl", {"text": "hi", "session_id": "q", "ts": 17}, {"session_id": "q"})
    assert [(r.text, r.session_id, r.timestamp) for r in S.codex_history(S.lines(spark, root)).collect()] == [("hi", "q", "17")]
    root = write(tmp_path / "c" / "c.jsonl", {"type": "user", "content": "hello", "timestamp": "t"}, {"type": "tool_use", "tool_name": "bash", "tool_input": {"command": "ls", "workdir": "/w"}}, {"type": "assistant", "content": "no"})
    assert sorted((r.event_type, r.text, r.command, r.session_id) for r in S.claude_transcript(S.lines(spark, root)).collect()) == [("message", "hello", None, "c"), ("tool_use", "bash", "ls", "c")]
    root = write(tmp_path / "k" / "p" / "x" / "k.jsonl", {"role": "assistant", "message": {"content": [{"type": "text", "text": "<think>hm"}]}}, {"role": "user", "message": {"content": [{"type": "text", "text": "q"}, {"type": "image", "text": "no"}]}})
    got = S.cursor_transcript(S.lines(spark, root)).collect()
    assert [(r.role, r.text) for r in got] == [("user", "q")] and got[0].cwd.endswith("/k")
    root = write(tmp_path / "g" / "g.jsonl", {"type": "odd", "content": ["a", "b"], "conversation_id": "z"}, {"role": "assistant", "message": "m", "command": "run"}, {"x": 1})
    assert sorted((r.role, r.text, r.event_type, r.session_id) for r in S.generic_jsonl(S.lines(spark, root)).collect()) == [("assistant", "m", "tool_use", "g"), ("user", "a\nb", "message", "z")]


def test_collect_counts_once(spark, tmp_path):
    a = write(tmp_path / "a" / "1.jsonl", {"role": "user", "text": "x"}, {"role": "user", "text": "y"})
    got = S.collect(spark, {"generic": a, "other": a})
    assert got.groupBy("source_tool").count().orderBy("source_tool").collect()[0]["count"] == 2 and got.count() == 2 * 2 - 2


def test_whole_files_and_frontmatter(spark, tmp_path):
    root = write(tmp_path / "n" / "note.md", "---\ntitle: My note\ntags: a\n---", "body")
    r = S.whole_files(spark, root).withColumn("f", S.frontmatter(S.F.col("text"))).collect()[0]
    assert (r.session_id, r.role, r.f) == ("note", "user", {"title": "My note", "tags": "a"})
    assert S.manual_notes(spark, root).first().event_type == "manual_note"


def test_stream_lands_each_row_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    df.coalesce(1).write.parquet(f"{source}/1")
    for n in range(2):
        land_new(read_new(spark, f"{source}/*", df.schema), "id", target, str(tmp_path / f"cp{n}"))
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2]
    spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string").write.parquet(f"{source}/2")
    land_new(read_new(spark, f"{source}/*", df.schema), "id", target, str(tmp_path / "cp1"))
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_values_are_carried_over_ranges_of_a_file(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from recollect.sources import transcripts

    monkeypatch.setattr(transcripts, "RANGE", 8)
    rng = random.Random(5)
    rows = [(f, i, rng.choice([None] * 12 + ["a", "b"])) for f in "xy" for i in range(100) if rng.random() < 0.8]
    want, last = {}, {}
    for f, i, v in rows:
        last[f] = v if v is not None else last.get(f)
        want[f, i] = last[f]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "source_path string, line_no int, v string")
    got = {(r.source_path, r.line_no): r.c for r in transcripts.carried(df, {"c": F.col("v")}).collect()}
    assert got == want
