"""Line numbers of split files, and streams of files that grow and shrink."""

import json
import random

from recollect.sources import transcripts
from recollect.streaming.growing import land_lines, read_growing


def test_lines_of_split_files_have_the_numbers_of_the_whole_file(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        rows = []
        for i in range(4000):
            kind = rng.random()
            rows.append("" if kind < 0.1 else "{broken" if kind < 0.2 else json.dumps({"text": "x" * rng.randrange(60), "i": i, "é": " "}, ensure_ascii=kind < 0.6))
        end = rng.choice(["\n", "\r\n"])
        (tmp_path / name).write_bytes((("﻿" if name == "b.jsonl" else "") + end.join(rows)).encode())
        want |= {(name, i): json.loads(r)["i"] for i, r in enumerate(rows) if r.startswith("{\"")}
    (tmp_path / "empty.jsonl").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = transcripts.lines(spark, str(tmp_path))
        got = {(r.source_path.rsplit("/", 1)[1], r.line_no): json.loads(r.raw_json)["i"] for r in found.collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_growing_files_land_once(spark, tmp_path):
    folder, files = f"file://{tmp_path}/t", tmp_path / "in"
    (files / "sub").mkdir(parents=True)
    held = {"a.jsonl": [f"line {i} é" for i in range(500)], "sub/b.jsonl": ["one", "", "three"]}

    def write():
        for name, rows in held.items():
            (files / name).write_text("".join(f"{r}\n" for r in rows))

    def land():
        land_lines(read_growing(spark, str(files), range="700"), folder, f"{tmp_path}/checkpoint")
        rows = spark.read.parquet(f"{folder}/lines").collect()
        assert len({(r.source_path, r.life, r.line_no) for r in rows}) == len(rows)
        out = {}
        for r in sorted(rows, key=lambda r: r.line_no):
            out.setdefault((r.source_path.split("/in/")[1], r.life), []).append(r.raw_json)
        return out

    write()
    with (files / "a.jsonl").open("a") as f:
        f.write("half a li")
    assert land() == {("a.jsonl", 0): held["a.jsonl"], ("sub/b.jsonl", 0): held["sub/b.jsonl"]}
    assert land() == {("a.jsonl", 0): held["a.jsonl"], ("sub/b.jsonl", 0): held["sub/b.jsonl"]}
    held["a.jsonl"] += ["half a line", "and more"]
    held["c.jsonl"] = ["new"]
    write()
    assert land() == {("a.jsonl", 0): held["a.jsonl"], ("sub/b.jsonl", 0): held["sub/b.jsonl"], ("c.jsonl", 0): ["new"]}
    before = held["sub/b.jsonl"]
    held["sub/b.jsonl"] = ["other"]
    write()
    assert land() == {("a.jsonl", 0): held["a.jsonl"], ("sub/b.jsonl", 0): before, ("sub/b.jsonl", 1): ["other"], ("c.jsonl", 0): ["new"]}
    cursors = {r.source_path.split("/in/")[1]: (r.life, r.size, r["lines"]) for r in __import__("recollect.operators.versions", fromlist=["Table"]).Table(spark, f"{folder}/cursors").read().collect()}
    assert cursors == {"a.jsonl": (0, (files / "a.jsonl").stat().st_size, 502), "sub/b.jsonl": (1, 6, 1), "c.jsonl": (0, 4, 1)}
