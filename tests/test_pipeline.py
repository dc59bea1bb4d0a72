import json

from pyspark.sql import functions as F

from recollect.functions import providers
from recollect.plans import pipeline


def test_a_second_run_changes_nothing(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    rows = [{"role": "user", "text": t, "timestamp": f"2024-01-01T00:00:0{i}Z", "session_id": "s"} for i, t in enumerate(["never push to main", "never push to main", "never push to main", "prefer short answers", "We decide to adopt the plan for it."])]
    (root / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    out = str(tmp_path / "tables")
    first = pipeline.run(spark, out, {"generic": str(root)}, now, **pipeline.DEFAULT_RULES)
    memories = sorted((r.title, r.status, r.route) for r in first["memories"].collect())
    assert memories == [("never push to main", "active", "procedures"), ("prefer short answers", "candidate", "inbox")]
    assert {r.change for r in first["page_changes"].collect()} == {"added"} and first["digests"].count() == 1
    again = pipeline.run(spark, out, {"generic": str(root)}, now, **pipeline.DEFAULT_RULES)
    assert sorted((r.title, r.status, r.route) for r in again["memories"].collect()) == memories
    assert again["raw_events"].count() == 5 and again["digests"].count() == 1 and again["page_changes"].count() == 0


def test_providers(spark):
    df = spark.createDataFrame([(1, "one text"), (2, None)], "id long, text string")
    prompt = F.concat(F.lit("title: "), F.coalesce("text", F.lit("")))
    plain = providers.answered(df, prompt, "t", providers.title("text", F.lit("")))
    assert [r.t for r in plain.orderBy("id").collect()] == ["one text", ""]
    asked = providers.answered(df, prompt, "t", F.lit("none"), lambda texts: [x.upper() if "one" in x else None for x in texts])
    assert [r.t for r in asked.orderBy("id").collect()] == ["TITLE: ONE TEXT", "none"]
    got = providers.embedded(df, F.col("text")).orderBy("id").collect()
    assert len(got[0].embedding) == 64 and abs(sum(x * x for x in got[0].embedding) - 1) < 1e-9 and not any(got[1].embedding)
    j = spark.range(1).select(providers.json_in(F.lit('so {"a": 1} there')).alias("j"), providers.keep_best(F.array(F.lit("a"), F.lit(""), F.lit("a"), F.lit("b")), 2).alias("k")).first()
    assert (j.j, j.k) == ('{"a": 1}', ["a", "b"])
