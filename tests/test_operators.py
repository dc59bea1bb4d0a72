import datetime as dt
import random
import statistics

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions import vocabulary as V
from recollect.operators import analytics, assisted, digest, distill, govern, index, search, vault, wiki
from recollect.sources.model import RAW_EVENT


def events(spark, texts, session="s", role="user", **more):
    rows = [(f"e{i:03}", "chat", "f", session, "message", f"2024-01-01T00:00:{i % 60:02}+00:00", role, None, more.get("project"), t, None, None, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, T.StructType([*RAW_EVENT.fields, T.StructField("line_no", T.IntegerType())]))


def items(spark, rows):
    base = {"title": "a title of some length", "summary": "a summary", "details": "details", "memory_type": "semantic", "scope": "global", "tool": "shared", "project_key": None, "confidence": 0.9, "stability": 0.8, "status": "active", "tags": [], "manual_override": False, "expiration_days": 90}
    t = dt.datetime(2024, 1, 1)
    full = [base | {"id": i, "created_at": t, "last_seen_at": None} | r for i, r in enumerate(rows, 1)]
    schema = "id long, title string, summary string, details string, memory_type string, scope string, tool string, project_key string, confidence double, stability double, status string, tags array<string>, manual_override boolean, expiration_days int, created_at timestamp, last_seen_at timestamp"
    order = [p.strip().split()[0] for p in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in full], schema)


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_snippets_cut_and_choose(spark):
    got = distill.snippets(events(spark, ["We must keep it tidy！prefer short names；nothing here of note", "abc", None, "must " * 200])).collect()
    assert [r.snippet for r in got][:2] == ["We must keep it tidy", "prefer short names"] and len(got) == 3


def test_preferences_and_repetitions(spark):
    once = distill.consolidate(events(spark, ["never push to main"])).collect()
    assert [(r.title, r.memory_type, r.status, r.confidence, r.repetitions) for r in once] == [("never push to main", "procedural", "candidate", 0.65, 1)]
    thrice = distill.consolidate(events(spark, ["never push to main"] * 3)).collect()[0]
    assert (thrice.confidence, thrice.stability, thrice.status, len(thrice.evidence)) == (0.81, 0.94, "active", 3)
    many = distill.consolidate(events(spark, ["must run the checks"] * 20)).collect()[0]
    assert (many.confidence, many.stability, len(many.evidence), many.repetitions) == (0.99, 0.99, 12, 20)
    assert many.details == " ".join(["must run the checks"] * 20)[:1600]
    profile = distill.consolidate(events(spark, ["prefer short answers"] * 5)).collect()[0]
    assert (profile.memory_type, profile.status) == ("profile", "candidate") and "needs-review" in profile.tags


def test_secrets_are_redacted_and_projects_reviewed(spark):
    got = distill.consolidate(events(spark, ["must set password to hunter2 there"], project="p-1")).collect()[0]
    assert got.sensitivity == "high" and got.details == "[redacted-sensitive]" and got.evidence[0].excerpt == "[redacted-sensitive]"
    fact = distill.consolidate(events(spark, ["the repository holds the controller"], project="p-1")).collect()[0]
    assert (fact.scope, fact.tool, fact.status) == ("project", "shared", "candidate")


def test_reconcile_keeps_what_was_overridden(spark):
    new = distill.consolidate(events(spark, ["never push to main"] * 3))
    known = new.withColumn("title", F.lit("mine")).withColumn("manual_override", F.lit(True)).withColumn("created_at", F.lit("t0")).withColumn("reviewed_at", F.lit("t1")).withColumn("managed_by", F.lit("user")).withColumn("expiration_days", F.lit(10))
    got = distill.reconcile(new, known).collect()[0]
    assert (got.title, got.created_at, got.reviewed_at, got.managed_by, len(got.evidence)) == ("mine", "t0", "t1", "user", 6)


def test_govern(spark):
    m = items(spark, [
        {"status": "candidate", "summary": "Same  thing"}, {"status": "candidate", "summary": "same thing"}, {"status": "candidate", "summary": "same thing", "project_key": "p"},
        {"status": "candidate", "title": "tiny", "summary": "other words"}, {"status": "candidate", "summary": "sure enough of it", "confidence": 0.78, "stability": 0.65},
        {"status": "candidate", "summary": "of a profile", "memory_type": "profile"}, {"status": "candidate", "summary": "not sure of it", "confidence": 0.5}, {},
    ])
    got = {r.id: (r.action, r.new_status) for r in govern.govern(m).collect()}
    assert got == {1: ("auto-promoted", "active"), 2: ("auto-merged-candidate", "archived"), 3: ("auto-promoted", "active"), 4: ("low-value-archived", "archived"), 5: ("auto-promoted", "active"), 6: ("needs-review", "candidate"), 7: ("kept", "candidate")}
    assert [(r["count"], r.first_id, r.last_id) for r in govern.duplicate_clusters(m).collect()] == [(2, 1, 2)]


def test_exclusive_p95(spark):
    for values in ([], [3.5], [1.0, 2.0], [1.0, 2.0, 4.0, 8.0], [float(i) for i in range(20)], [float(i * i) for i in range(100)], [5.0] * 30 + [7.0]):
        df = spark.createDataFrame([(v,) for v in values], "a double")
        want = statistics.quantiles(values, n=20)[-1] if len(values) > 1 else (values or [0.0])[0]
        assert abs(govern.age_p95(df, F.col("a")).first().p95 - want) < 1e-9
        array = spark.range(1).select(govern.exclusive_p95(F.array(*map(F.lit, values)).cast("array<double>")).alias("p")).first().p
        assert abs(array - want) < 1e-9


def test_repair(spark):
    m = items(spark, [{"stability": 1.5}, {"title": "what? is it", "manual_override": True}, {"title": "what? is it"}, {}]).withColumn("created_at", F.when(F.col("id") == 4, "soon").otherwise("1700000000")).drop("last_seen_at")
    fixed, changes = govern.repair(m, ("created_at",))
    assert {r.id: (r.status, r.stability) for r in fixed.collect()} == {1: ("active", 1.0), 2: ("archived", 0.8), 4: ("active", 0.8)}
    assert sorted((r.id, r.kind) for r in changes.collect()) == [(1, "stability_clamped"), (1, "timestamp_normalized"), (2, "garbled_manual_archived"), (2, "timestamp_normalized"), (3, "garbled_system_removed"), (3, "timestamp_normalized"), (4, "skipped")]


def test_reviews_and_expiry(spark):
    m = items(spark, [{"confidence": 0.5, "status": "candidate"}, {}, {}, {"expiration_days": 10}])
    r = spark.createDataFrame([(1, "confirm", None, "t1"), (2, "merge", None, "t1"), (3, "contradict", 1, "t1"), (3, "archive", None, "t0")], "id long, action string, target_id long, reviewed_at string")
    got = {x.id: (x.status, x.confidence, x.supersedes) for x in govern.apply_reviews(m, r).collect()}
    assert got == {1: ("active", 0.9, None), 2: ("active", 0.9, None), 3: ("contradicted", 0.9, 1), 4: ("active", 0.9, None)}
    assert ids(govern.expired(m, F.to_timestamp(F.lit("2024-01-12 00:00:00")))) == [4]


def test_search_ways(spark):
    m = items(spark, [{"title": "red apple", "summary": "apple apple"}, {"title": "green pear", "details": "an apple"}, {"title": "blue plum", "tool": "x", "status": "candidate"}, {"title": "apple gone", "status": "archived"}, {"title": "naïve_term 中文段落"}])
    # one side alone: by priority, then title
    assert ids(search.memory_search(m, "apple")) == [2, 1]
    assert ids(search.memory_search(m, "naïve"))[0] == 5
    assert ids(search.memory_search(m, "blue zzz", limit=5)) == [3]
    near = spark.createDataFrame([(3, 0.9), (2, 0.1), (4, 1.0)], "id long, similarity double")
    assert ids(search.memory_search(m, "apple", near, limit=3))[0] == 3
    assert ids(search.memory_search(m, "nothing such", limit=2)) == [] and len(ids(search.memory_search(m, "", limit=2))) == 2
    assert ids(search.memory_search(m, "apple", tags=["no"])) == []


def test_cosine_guards(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0, 1.0]), (5, [1.0, 1.0])], "id long, embedding array<double>")
    assert {r.id: round(r.similarity, 4) for r in search.vector_scores(v, [2.0, 0.0]).collect()} == {1: 1.0, 5: 0.7071}


def test_context_sections(spark):
    m = items(spark, [{"memory_type": "procedural"}, {"memory_type": "procedural", "confidence": 0.8, "tags": ["watchout"]}, {"memory_type": "semantic", "tags": ["watchout"]}] + [{"memory_type": "profile"}] * 9)
    got = search.context_sections(m).groupBy("section").count().collect()
    assert {r.section: r["count"] for r in got} == {"must_follow": 1, "watch_outs": 2, "known_patterns": 1, "preferences": 8}


def test_chunks_and_digests(spark):
    for n, want in ((3, {"s"}), (4, {"s-chunk-0"}), (20, {"s-chunk-0"}), (41, {"s-chunk-0", "s-chunk-1", "s-chunk-2"})):
        assert {r.chunk_id for r in digest.chunks(events(spark, [f"message {i}" for i in range(n)]), ("line_no",)).collect()} == want
    made = digest.digests(events(spark, ["hi", "We decide to adopt the plan. It is an important key point of all! next step: look at the numbers again", "We decide to adopt the plan.", "```sql\nselect 1\n```"])).collect()[0]
    assert made.title.startswith("We decide") and made.key_decisions == ["We decide to adopt the plan"] and made.insights == ["It is an important key point of all"]
    assert made.follow_ups == ["next step: look at the numbers again"] and made.code[0].lang == "sql" and made.category == "exploration"
    assert digest.chunks(events(spark, ["x"], session=None)).first().chunk_id == "unknown"


def test_skills(spark):
    s = digest.skills_from_sessions(events(spark, ["fix the api error", "we decide to use docker for it", "ok then go on", "save as skill please"])).collect()[0]
    assert (s.category, s.requested, s.name) == ("debug", True, "fix the api error") and "docker" in s.required_tools and s.steps[0].startswith("we decide")
    t = spark.createDataFrame([(1, "draft", 0, 0), (2, "active", 5, 2), (3, "active", 4, 0)], "id long, status string, usage_count long, success_count long")
    assert sorted((r.id, r.reason) for r in analytics.for_review(t).collect()) == [(1, "draft"), (2, "low_success")]


def test_edges(spark):
    d = spark.createDataFrame([("d1", "big red house", None, [], []), ("d2", "small", "p", [], [])], "id string, title string, related_project string, insights array<string>, fragments array<string>")
    m = items(spark, [{"title": "red house"}, {"title": "red car"}, {"title": "none", "project_key": "p"}])
    assert sorted((r.digest_id, r.memory_id, r.score) for r in digest.edges(d, m).collect()) == [("d1", "1", 0.4), ("d2", "3", 0.5)]


def test_milestones(spark):
    got = spark.createDataFrame([(n,) for n in (9, 10, 60, 500, 5000)], "n long").select(analytics.milestone(F.col("n")).alias("m")).collect()
    assert [(r.m.reached, r.m.next, r.m.progress_pct) if r.m else None for r in got] == [None, (10, 25, 16.7), (50, 100, 60.0), (500, None, 90.9), (500, None, 100.0)]


def test_full_edge_score_finds_all(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher

    monkeypatch.setattr(digest, "TILE", (7, 5))
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["Log", "python", "rules", "日志记录", "naïve", "qz", "house", "of"]) for _ in range(n))
    ds = [(f"d{i}", say(rng.randint(0, 5)), [say(3)] * rng.randint(0, 2), ["片段 (sql)"] * rng.randint(0, 1), rng.choice(["p", "q", "", None])) for i in range(25)]
    ms = [{"title": say(rng.randint(0, 4)), "summary": say(rng.randint(0, 6)), "details": say(rng.choice([0, 3, 60])), "project_key": rng.choice(["p", "r", "", None]), "tags": ["xyz"] * rng.randint(0, 1)} for _ in range(30)]
    ms += [dict(ms[0]), {"title": ds[0][1], "summary": " ".join(ds[0][2]), "details": " ".join(ds[0][3])}]
    d = spark.createDataFrame(ds, "id string, title string, insights array<string>, fragments array<string>, related_project string")
    want = {}
    for i, title, insights, fragments, project in ds:
        for n, m in enumerate(ms, 1):
            ours, theirs = f"{title} {' '.join(insights)} {' '.join(fragments)}".lower(), f"{m['title']} {m['summary']} {m['details']} {' '.join(m.get('tags', []))}".lower()
            r = SequenceMatcher(None, ours, theirs).ratio()
            score = max(r if r >= 0.3 else 0, 0.4 * (len(set(title.lower().split()) & set(m["title"].lower().split())) >= 2), 0.5 * bool(project and project == m.get("project_key")))
            if score >= 0.3:
                want[i, str(n)] = (score, "extends" if score >= 0.6 else "relates_to")
    got = digest.edges(d, items(spark, ms), True).collect()
    assert len(got) == len(want) and {(r.digest_id, r.memory_id): (r.score, r.connection_type) for r in got} == want
    assert {0.4, 0.5} < {s for s, _ in want.values()} and {t for _, t in want.values()} == {"extends", "relates_to"}


def test_bounds_hold():
    import random
    from difflib import SequenceMatcher

    from recollect.functions.similarity import Matchable, common_letters, common_subsequence, letter_counts

    rng = random.Random(2)
    kinds = ["ab", "abcdefgh zqx", "etaoin shrdlu,日志é" * 3 + "qz7"]
    draw = lambda n: "".join(rng.choice(rng.choice(kinds)) for _ in range(n))
    for _ in range(60):
        long = draw(rng.randint(200, 700))
        texts = [draw(rng.randint(0, 90)) for _ in range(6)] + [long[i : i + rng.randint(1, 64)] for i in (0, 0, 40, 90)] + ["", long[:30] + draw(20), draw(5) + long[60:160]]
        long_first = SequenceMatcher(None, "", long)
        bound = Matchable(texts).within(long, long_first.b2j)
        letters = common_letters(letter_counts([long])[0].astype(int), letter_counts(texts).astype(int))
        codes = np.zeros((1, len(long)), np.int64)
        codes[0] = [ord(c) for c in long]
        for i, t in enumerate(texts):
            long_first.set_seq1(t)
            matched = sum(b.size for b in long_first.get_matching_blocks())
            assert matched <= bound[i] and matched <= letters[i]
            if len(t) <= 64:
                assert matched <= common_subsequence(t, codes)[0] <= len(t)


def test_wiki(spark):
    m = items(spark, [
        {"title": "Use python logging", "summary": "always log", "tags": ["python", "rule"], "project_key": "p"}, {"title": "Skip python logging", "summary": "never log", "tags": ["python"], "project_key": "p"},
        {"title": "Use python loggings", "summary": "always log", "tags": ["workflow"], "project_key": "p"},
    ])
    assert [(r.topic, r["items"]) for r in wiki.topics(m).collect()] == [("python", 2)]
    assert [tuple(r) for r in wiki.conflicts(m, V.POSITIVE, V.NEGATIVE).collect()] == [("python", 1, 2)]
    assert (1, 3) in [(r.first_id, r.second_id) for r in wiki.duplicate_concepts(m).collect()]
    pages = {r.page_key: r.content for r in wiki.pages(m).collect()}
    assert set(pages) == {"types/semantic", "projects/p/index", "topics/python"} and pages["types/semantic"].startswith("# Patterns\n\nGenerated from `3`")
    after = m.filter("id <> 3")
    assert {r.page_key for r in wiki.affected_pages(m, after).collect()} == {"types/semantic", "projects/p/index"}
    assert {(r.page_key, r.change) for r in wiki.changed_pages(wiki.pages(m), wiki.pages(after)).collect() if r.part == 1} == {("types/semantic", "changed"), ("projects/p/index", "changed")}


def test_pages_and_index_hold_everything_in_parts(spark):
    m = items(spark, [{"title": f"t{i:03}", "project_key": f"proj-{i % 300:03}", "confidence": 0.5 + i % 7 / 100, "tags": ["all"]} for i in range(500)])
    parts = sorted((r.page_key, r.part, r.content) for r in wiki.pages(m).collect())
    whole = lambda rows, key: "".join(c for k, _, c in rows if k == key)
    page = whole(parts, "types/semantic")
    assert [p for k, p, _ in parts if k == "types/semantic"] == [1, 2, 3] and page.count("\n- **") == 500
    titles = [line.split("**")[1] for line in page.split("\n") if line.startswith("- **")]
    assert titles == [f"t{i:03}" for i in sorted(range(500), key=lambda i: (-(i % 7), i))]
    assert page.startswith("# Patterns\n\nGenerated from `500`") and page.endswith("\n") and "\n\n\n" not in page
    front = sorted((r.page_key, r.part, r.content) for r in wiki.front_pages(m, wiki.lint_report(m, F.lit(0))).collect())
    index_ = whole(front, "index")
    assert index_.count("\n- [[projects/") == 300 and "\n\n## Topics\n- [[topics/all|all]]\n" in index_ and "\n\n\n" not in index_


def test_numbers_of_a_group_over_many_ranges(spark):
    from recollect.operators.ranks import numbered

    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 > 0, F.concat(F.lit("k"), (F.col("id") % 99).cast("string"))).alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(rows, ["g"], [F.desc("id")], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = {}
    for r in sorted(got, key=lambda r: -r.id):
        held.setdefault(r.g, []).append(r.n)
    assert len(got) == 5000 and all(n == list(range(1, len(n) + 1)) for n in held.values())


def test_near_titles_finds_all(spark):
    import itertools
    import random

    random.seed(3)
    words = [f"w{c}" for c in "abcdefghij"]
    m = items(spark, [{"title": " ".join(f"{w}x" for w in random.sample(words, random.randint(1, 6)))} for _ in range(60)])
    sets = {r.id: set(r.title.split()) for r in m.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = wiki.near_titles(m)
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    nodes = set(first.values())
    assert {(r.first_id, r.second_id) for r in got.collect()} == {(a, b) for a, b in want if a in nodes and b in nodes} | {(first[frozenset(sets[i])], i) for i in sets if i not in nodes}


def test_duplicate_concepts_finds_all(spark, monkeypatch):
    import itertools
    import random
    from difflib import SequenceMatcher

    monkeypatch.setattr(wiki, "TILE", 16)
    rng = random.Random(8)
    bases = ["Use python logging", "use PYTHON logging", "日志记录的规则与方法", "правила ведения журнала", "a b c d e f", "", "x" * 70 + " and more of it", "Trash the license of the reserved house"]
    made = []
    for _ in range(90):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("aé日 z")
        made.append({"title": "".join(t), "summary": rng.choice(["always log", "always logs", "日志", "never mind at all"]), "project_key": rng.choice(["p", None]), "memory_type": rng.choice(["semantic", "procedural"])})
    made += [dict(made[0]), dict(made[0]), dict(made[0], summary="quite another summary"), dict(made[0], title="logging python use")]
    m = items(spark, made)
    rows = m.select("id", "project_key", "memory_type", "title", "summary").orderBy("id").collect()
    sim = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()
    want = {}
    for a, b in itertools.combinations(rows, 2):
        if (a.project_key, a.memory_type) == (b.project_key, b.memory_type):
            t, s = sim(a.title, b.title), sim(a.summary, b.summary)
            if t >= 0.83 or (t >= 0.72 and s >= 0.72):
                want[a.id, b.id] = (t, s)
    got = wiki.duplicate_concepts(m).collect()
    assert len(got) == len(want) > 100 and {(r.first_id, r.second_id): (r.title_ratio, r.summary_ratio) for r in got} == want


def test_vault(spark):
    n = vault.notes(events(spark, ["计划：write the roadmap for the coming weeks", "short", "计划：write the roadmap for the coming weeks", "计划：write the roadmap for the coming weeks and so on"], project="team-1"))
    g = vault.grouped_notes(n).orderBy("title").collect()
    assert sum(r.events for r in g) == 3 and all(r.note_type == "计划" for r in g) and g[0].title.startswith("write the roadmap")
    m = items(spark, [{"memory_type": "procedural"}, {"memory_type": "procedural", "created_at": dt.datetime(2024, 2, 1)}, {"memory_type": "semantic"}])
    assert ids(vault.rule_notes(m)) == [2]
    paths = [r.path for r in vault.paths(n).collect()]
    assert len(paths) == len(set(paths)) == 3 and sum(p.endswith("-2.md") for p in paths) == 1


def test_files_of_the_vault(spark):
    rules = items(spark, [{"title": "a/b: c", "tags": ["x", "y"]}, {"title": "a/b: c"}]).withColumn("evidence", F.lit(None).cast("array<struct<source_tool:string,excerpt:string>>"))
    rules = rules.withColumn("created_at", F.lit("2024-02-03T00:00:00+00:00")).withColumn("last_seen_at", F.lit(None).cast("string"))
    got = vault.files(vault.rule_files(rules)).orderBy("path").collect()
    assert [r.path for r in got] == ["rules/2024-02-03_规则_a-b- c-2.md", "rules/2024-02-03_规则_a-b- c.md"]
    assert 'project: ""\n' in got[1].content and "tags:\n  - semantic\n  - x\n  - y\n  - 长期规则\ncreated:" in got[1].content and f'source: "{V.RULE_SOURCE}shared"\n' in got[1].content and 'updated: "2024-02-03T00:00:00+00:00"' in got[1].content
    assert got[0].content.endswith("## 证据\n- 暂无证据摘要\n")
    notes = spark.createDataFrame([(1, "t", "we decide: " + "x" * 90), (2, "t", "rule " + "x" * 90), (3, "t", " rule" + " " * 99), (4, "t", None), (5, "t", "a rule " + "y" * 999)], "note_id long, title string, text string")
    made = vault.imported(notes, notes.filter("note_id = 5").select("note_id")).collect()
    assert [(r.note_id, len(r.summary), r.confidence) for r in made] == [(2, 72, 0.92)]


def test_notes_hold_every_block_in_parts(spark):
    from pyspark.sql import Row

    n = 120
    rows = [Row(id=f"e{i:03}", source_tool="codex", session_id=None if i % 2 else "s", timestamp=f"2024-03-01T{i // 60:02}:{i % 60:02}:00Z", role="user", cwd="/w/my app/", project_key=None, text=f"计划 roadmap\n- step {i % (n - 5)}\n- b\n- c" + " x" * 60) for i in range(n)]
    found = vault.notes(spark.createDataFrame(rows, "id string, source_tool string, session_id string, timestamp string, role string, cwd string, project_key string, text string"), V.NOTE_TYPES, F.lit(True))
    got = sorted((r.part, r.path, r.content) for r in vault.files(vault.conversation_files(found)).collect())
    assert [p for p, _, _ in got] == [1, 2, 3] and {p for _, p, _ in got} == {"projects/my app/计划/2024-03-01_计划_计划 roadmap.md"} or got[0][1].startswith("projects/my app/")
    whole = "".join(c for _, _, c in got)
    head, body = whole.split("---\n\n", 1)
    # equal texts at other times are blocks of their own
    assert whole.count("## 内容") == n and body.startswith("# 计划 roadmap\n\n## 摘要\n") and whole.endswith("\n") and not whole.endswith("\n\n")
    assert 'status: "draft"' in head and 'source: "codex:user"' in head and 'project: "my app"' in head and 'project_key: "my-app-' in head
    assert body.count("- 会话: unknown\n") == n // 2 and "- 工作目录: /w/my app/\n- 置信度: 0." in body and "- 时间: 2024-03-01T00:01:00+00:00\n" in body


def test_documents_of_a_week(spark):
    day = lambda d: dt.datetime(2024, 3, d)
    base = {"memory_type": "procedural", "tags": ["rule"]}
    m = items(spark, [base | {"summary": f"Rule {i % 10}: 必须 do this every time", "last_seen_at": day(1 + i % 28)} for i in range(40)] + [base | {"summary": "old 必须 but forgotten", "last_seen_at": dt.datetime(2023, 1, 1)}, base | {"summary": "必须 of a project", "scope": "project", "last_seen_at": day(5)}])
    notes = spark.createDataFrame([(f"2024-03-{d:02}T00:00:00+00:00", f"title {d} 必须 检查 结论", k, "p", 0.9, r) for d, k, r in ((27, "计划", "inbox"), (28, "复盘", "project"), (26, "决策", "project"), (3, "规则", "inbox"))], "timestamp string, title string, note_type string, project_name string, confidence double, route string")
    got = {r.name: r.content for r in vault.weekly_documents(m, notes, F.lit("2024-03-29").cast("timestamp")).collect()}
    habits, lessons = got["工作模式和偏好.md"], got["经验与教训.md"]
    assert habits.startswith("# 工作模式和偏好\n\n## 当前稳定模式\n- Rule ") and habits.count("\n- Rule ") == 8 and "forgotten" not in habits and "of a project" not in habits
    assert "## 本周新增观察（2024-W13）\n- title 27 必须 检查 结论\n\n## 待确认\n- title 27 必须 检查 结论\n\n## 更新规则\n" in habits and "title 3 " not in habits
    assert "## 本周经验（2024-W13）\n- title 26 " in lessons and "## 本周教训与风险\n- title 28 " in lessons and lessons.endswith("没有结论的执行记录。\n")
    none = {r.content for r in vault.weekly_documents(m.limit(0), notes.limit(0), F.lit("2024-03-29").cast("timestamp")).collect()}
    assert any("- 暂无稳定偏好总结。" in c for c in none) and len(none) == 2


def test_front_pages_and_heads(spark):
    m = items(spark, [{"project_key": "0123456789abcdef", "tags": ["a", "b c"]}, {"project_key": "0123456789abcdef", "tags": ["a"]}, {"project_key": None, "tags": None}])
    issues = wiki.lint_report(m, F.lit(0))
    front = {r.page_key: r.content for r in wiki.front_pages(m, issues).collect() if r.part == 1}
    assert "- Topic pages: `1`" in front["health"] and "- `weak_evidence`: `3`" in front["health"] and "Low Quality Project Names\n- `0123456789abcdef`" in front["health"]
    assert front["index"].startswith("# Memory Wiki\n\n## Overview\n- Active memories: `3`\n- [[types/profile|Profiles]]") and front["index"].endswith("## Topics\n- [[topics/a|a]]\n")
    made = {r.page_key: r.content for r in wiki.pages(m, issues=issues).collect()}
    assert "## Governance Warnings\n- `weak_evidence` Memory `1` has weak" in made["projects/0123456789abcdef/index"]
    assert "- Unique projects: `1`" in made["topics/a"] and "- Projects: [[projects/0123456789abcdef/index" in made["topics/a"]
    none = m.limit(0)
    empty = {r.page_key: r.content for r in wiki.front_pages(none, wiki.lint_report(none, F.lit(0))).collect()}
    assert "- No project pages yet." in empty["index"] and "- No issues detected." in empty["health"] and wiki.pages(none).count() == 0


def test_index(spark):
    known = spark.createDataFrame([(1, "a")], "id long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "id long, v string")
    assert [tuple(r) for r in index.insert_or_ignore(known, new).collect()] == [(2, "c")]
    p = {(r.term, r.id): r.weight for r in index.postings(items(spark, [{"title": "red red", "summary": "red"}]), search.WEIGHTS).collect()}
    assert p[("red", 1)] == 10.0 and p[("details", 1)] == 1.0


def test_stored_index_scores_as_the_scan_does(spark, tmp_path):
    made = items(spark, [{"title": "red red fox", "summary": "naïve fox"}, {"title": "", "summary": None, "details": ""}, {"title": "a fox", "details": "red " * 300}, {"title": "other"}, {"title": "Ärger", "tags": ["red"]}])
    index.write_search_index(made, str(tmp_path / "i"), search.WEIGHTS, buckets=4, parts=3)
    for q in ("red fox", "naïve", "ärger red", "absent"):
        want = {r.id: round(r.score, 9) for r in search.bm25(made, q).collect()}
        assert {r.id: round(r.score, 9) for r in search.bm25_indexed(spark, str(tmp_path / "i"), q, buckets=4).collect()} == want
    assert search.bm25_indexed(spark, str(tmp_path / "i"), "!?", buckets=4).collect() == []


def test_find_falls_back_on_the_inbox(spark):
    from recollect.operators import search

    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    inbox = spark.createDataFrame([(2, "old"), (3, "new")], "id long, title string")
    assert [[r.title for r in search.find(items, inbox, i).collect()] for i in (1, 2, 3, 4)] == [["a"], ["b"], ["new"], []]


def test_skill_lifecycle(spark):
    from recollect.operators import lifecycle

    skills = spark.createDataFrame([(1, "draft"), (2, "draft"), (3, "active"), (4, "archived"), (5, "active")], "id long, status string")
    log = [(1, "promote", 1), (1, "demote", 2), (1, "promote", 3), (2, "archive", 1), (2, "promote", 2), (3, "demote", 1), (4, "promote", 1), (9, "promote", 1), (5, "other", 1)]
    got = lifecycle.reviewed_skills(skills, spark.createDataFrame(log, "id long, action string, at long")).collect()
    assert {r.id: r.status for r in got} == {1: "active", 2: "archived", 3: "draft", 4: "archived", 5: "active"}
    rounds = spark.createDataFrame([("u", i, i % 7 != 0) for i in range(40)] + [("v", i, False) for i in range(50)], "user string, n long, up boolean")
    from pyspark.sql import functions as F

    conf = 0.5
    for i in range(40):
        conf = min(0.99, conf + 0.05) if i % 7 else max(0.1, conf - 0.02)
    got = {r.user: r for r in lifecycle.profile_confidence(rounds, "user", F.col("n"), F.col("up")).collect()}
    assert abs(got["u"].confidence - conf) < 1e-9 and got["v"].confidence == 0.1 and got["v"].cycles == 50


def test_memory_files_are_read(spark, tmp_path):
    import json

    from recollect.sources.model import read_memories

    one = {"id": "m1", "title": "t", "memory_type": "semantic", "scope": "global", "tool": "shared", "summary": "s", "status": "active", "confidence": 0.9, "stability": 0.8, "tags": ["a"]}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "m1.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "many.json").write_text(json.dumps([one | {"id": "m2"}, one | {"id": "m3", "confidence": 7}, one | {"id": None}]))
    (tmp_path / "other.txt").write_text("{}")
    got = {r.id: r for r in read_memories(spark, str(tmp_path)).collect()}
    assert set(got) == {"m1", "m2"} and got["m1"].file_path.endswith("deep/m1.json") and got["m1"].modified_at


def test_edges_by_two_shared_words(spark):
    """Each pair that shares two title words is made once, pairs of one shared word never; words of one id in several rows count together."""
    rng = random.Random(31)
    title = lambda: " ".join(rng.choice(["the", "of", "a", "b", "c", *(f"w{i}" for i in range(30))]) for _ in range(rng.randrange(9)))
    ds = [(f"d{i}", title(), "p") for i in range(60)]
    ms = [(i, title(), "p") for i in range(80)] + [(7, title(), "p"), (9, title(), "p"), (200, None, "p")]
    d = spark.createDataFrame(ds, "id string, title string, related_project string").withColumn("insights", F.array().cast("array<string>")).withColumn("fragments", F.array().cast("array<string>"))
    m = spark.createDataFrame(ms, "id long, title string, project_key string").withColumn("summary", F.lit("")).withColumn("details", F.lit("")).withColumn("tags", F.array().cast("array<string>"))
    want = {}
    for i, t, _ in ds:
        for j, u, _ in ms:
            want[i, str(j)] = want.get((i, str(j)), 0) + len(set(t.split()) & set((u or "").split()))
    got = digest.edges(d, m, by_project=False)
    assert sorted((r.digest_id, r.memory_id) for r in got.collect()) == sorted(k for k, n in want.items() if n >= 2)
    unique = digest._sharing_words(d.select(F.col("id").alias("digest_id"), F.split("title", " ").alias("dw")).limit(0), m.select(F.col("id").alias("memory_id"), F.split("title", " ").alias("mw")).limit(0))
    assert "Aggregate" not in unique._jdf.queryExecution().optimizedPlan().toString()


def test_contradictions_without_pairs(spark, monkeypatch):
    """Members of conflicts of one type and scope are those that pairs name, and no pairs are made for them."""
    rng = random.Random(32)
    rows = [(i, " ".join(rng.sample(["alpha", "beta", "gamma", "delta", "epsilon"], 2)), rng.choice(["yes", "never", "plain"]), rng.choice(["profile", "procedural", "semantic"]), rng.choice(["global", "project", None]), rng.choice([None, "p"]), [rng.choice(["x", "y"])]) for i in range(120)]
    items = spark.createDataFrame(rows, "id long, title string, summary string, memory_type string, scope string, project_key string, tags array<string>").withColumn("details", F.lit(""))
    pairs = assisted.model_contradictions(wiki.conflicts(items, ("yes",), ("never",)), items).collect()
    want = {i for r in pairs for i in (r.first_id, r.second_id)}
    monkeypatch.setattr(wiki, "conflicting_pairs", None)
    found = assisted.contradicting(items, ("yes",), ("never",))
    assert {r.id for r in found.collect()} == want and 0 < len(want) < 80
    tagged = assisted.with_conflict_tags(items, found).filter("array_contains(tags, 'potential-conflict')")
    assert {r.id for r in tagged.collect()} == want


def test_conflicts_are_made_once(spark, monkeypatch):
    """Each conflicting pair comes once, without a shuffle of pairs, whatever words titles share; ids of several rows too."""
    monkeypatch.setattr(wiki, "MEMBERS", 3)
    rng = random.Random(33)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(5))), rng.choice(["yes", "never", "plain"]), rng.choice([None, "p"]), rng.sample(["x", "y"], rng.randrange(3))) for i in range(90)]
    for rows, shuffled in ((rows, False), (rows + [(i, *rows[i + 1][1:]) for i in range(20)], True)):
        made = spark.createDataFrame(rows, "id long, title string, summary string, project_key string, tags array<string>").withColumn("details", F.lit(""))
        want = set()
        for i, t, p, k, tags in rows:
            for j, u, q, m, more in rows:
                if (p, q) == ("yes", "never") and k == m and set(t.split()) & set(u.split()):
                    want |= {(x, min(i, j), max(i, j)) for x in set(tags) & set(more)}
        found = wiki.conflicts(made, ("yes",), ("never",))
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate") == shuffled


def test_titles_are_compared_once(spark):
    """What follows the comparison of titles reads its pairs, and summaries are compared in the order of ids alone."""
    rows = [{"title": "Use python logging", "summary": s} for s in ("tide", "diet", "tide")] + [{"title": "use python loggings", "summary": "diet"}]
    found = wiki.duplicate_concepts(items(spark, rows))
    assert "InArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.first_id, r.second_id): r.summary_ratio for r in found.collect()}
    assert got == {(1, 2): 0.25, (1, 3): 1.0, (2, 3): 0.5, (1, 4): 0.25, (2, 4): 1.0, (3, 4): 0.25}
