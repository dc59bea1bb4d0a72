"""The segmented search index against a scan of the items that it stands for."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.functions.text import project_reference
from recollect.operators import search, segments
from recollect.operators.versions import Table

WORDS = [f"w{i}" for i in range(40)]
COLUMNS = "id long, title string, summary string, details string, tags array<string>, status string, scope string, project_key string, tool string, confidence double, stability double, memory_type string, created_at timestamp, last_seen_at timestamp"


def made(rng, i):
    said = lambda n: " ".join(WORDS[min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.randrange(n)))
    return (i, said(6), said(20), said(120), rng.sample(["a", "b", "w1"], 2), rng.choice(["active", "candidate", "archived"]), "global", rng.choice([None, "p", "q"]), rng.choice(["shared", "t"]), rng.random(), 0.5, "semantic", None, None)


def same(index, items, rng):
    for query, kw in (("w0 w3 w39", {"project": "q", "tool": "t"}), ("W7 w8 nothing", {})):
        fine, fetch = search.visible(**kw), rng.choice([1, 5, 40])
        want = search.bm25(items.filter(fine), query, carry=("confidence",)).orderBy(F.desc(F.round("score", 9)), F.desc("confidence"), "id").limit(fetch)
        got = index.top(query, fetch, fine)
        assert sorted((r.id, round(r.score, 8)) for r in got.collect()) == sorted((r.id, round(r.score, 8)) for r in want.collect()), (query, kw, fetch)


def test_upkeep_gives_what_a_rebuild_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 4)
    monkeypatch.setattr(segments, "WIDTH", 3)
    rng = random.Random(6)
    held = {i: made(rng, i) for i in range(300)}
    table = lambda rows: spark.createDataFrame(list(rows), COLUMNS)
    index = segments.SearchIndex(spark, f"file://{tmp_path}/ix", search.WEIGHTS, buckets=3)
    index.apply(table(held.values()))
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    whole = size()
    for step in range(3):
        changed = [made(rng, i) for i in [*rng.sample(sorted(held), 3), 1000 + step, 2000 + step]]
        gone = rng.sample(sorted(held), 2)
        before = size()
        index.apply(table(changed + [held[i] for i in rng.sample(sorted(held), 3)]), table([made(rng, i) for i in gone]))
        if step == 0:
            assert size() - before < whole / 2
        named = {c[0] for c in changed}
        held = {i: r for i, r in held.items() if i not in gone or i in named} | {c[0]: c for c in changed}
    rest = {r.id: r for r in index.items().collect()}
    assert rest.keys() == held.keys() and all(rest[i].title == held[i][1] for i in held)
    assert "details" not in index.items().columns
    same(index, table(held.values()), rng)
    index.merge(everything=True)
    assert len(index.log.live()) == 1
    same(segments.SearchIndex(spark, f"file://{tmp_path}/ix", search.WEIGHTS, buckets=3), table(held.values()), rng)


def test_search_and_context_over_the_index(spark, tmp_path):
    rng = random.Random(7)
    items = spark.createDataFrame([made(rng, i) for i in range(200)], COLUMNS)
    index = segments.SearchIndex(spark, f"file://{tmp_path}/ix", search.WEIGHTS, buckets=3)
    index.build(items)
    near = items.select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("similarity"))
    rows = lambda df: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()]
    shown = ["id", "score", "similarity", "hybrid_score"]
    for query, vectors, kw in (("w5 w30", near, {}), ("w5 w30", None, {"project": "p"}), ("zzz", near, {}), ("w3", near, {"tags": ["a", "b"]})):
        scan = search.memory_search(items, query, vectors, 8, **kw).select(*shown)
        found = search.memory_search(items, query, vectors, 8, index=index, **kw)
        assert rows(found.select(*shown)) == rows(scan), (query, kw)
        assert "details" not in found.columns and "details" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(rows(search.memory_search(items, "w1", index=index).select("id"))) > 0
    phrase = items.filter(F.length("title") > 8).first().title[1:7]
    assert rows(search.memory_search(items, phrase + "zzz", index=index).select("id")) == rows(search.memory_search(items, phrase + "zzz").select("id"))
    for query in ("w4 w9",):
        want = rows(search.memory_context(items, query, None, "p", "t").select("section", "rank", "id"))
        assert sorted(rows(search.memory_context(items, query, None, "p", "t", index=index).select("section", "rank", "id"))) == sorted(want) and want


def test_texts_are_shuffled_once_and_packed(spark, tmp_path, monkeypatch):
    """A build shuffles its postings alone, a few bytes of each; blocks packed in several goes are those of a scan."""
    rng = random.Random(9)
    rows = [made(rng, i) for i in range(600)]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{tmp_path}/items")
    items = spark.read.parquet(f"{tmp_path}/items")
    monkeypatch.setattr(segments, "BLOCK", 16)
    monkeypatch.setattr(segments, "PACK", 500)
    monkeypatch.setattr(segments, "PART", 300)
    exchanges = lambda: sum(s.shuffleWriteBytes() for s in map(store.lastStageAttempt, range(before, jobs())))
    store, jobs = spark.sparkContext._jsc.sc().statusStore(), lambda: max((s.stageId() for s in _seq(store)), default=-1) + 1

    def _seq(store):
        held = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return [held.apply(i) for i in range(held.size())]

    index = segments.SearchIndex(spark, f"file://{tmp_path}/ix", search.WEIGHTS, buckets=3)
    before = jobs()
    index.build(items)
    postings = sum(len({*(w for t in (r[1], r[2], r[3]) for w in t.split()), *r[4]}) for r in rows)
    assert 0 < exchanges() < 60 * postings
    same(index, items, rng)


def test_index_without_items(spark, tmp_path):
    index = segments.SearchIndex(spark, f"file://{tmp_path}/ix", search.WEIGHTS)
    assert index.items() is None and index.top("w1", 5).count() == 0
    empty = spark.createDataFrame([], COLUMNS)
    index.build(empty)
    index.apply(empty, empty)
    assert index.top("w1", 5).count() == 0


@pytest.mark.parametrize("value", ["/home/me/My Repo/", "C:\\work\\x", "my-app-0123456789abcdef", "label", "~/x y", "/"])
def test_projects_are_named_as_columns_name_them(spark, value):
    want = spark.range(1).select(project_reference(F.lit(value))).first()[0] if not value.startswith("~") else None
    assert search.project_label(value) == want or value.startswith("~")


def test_table_switches_in_one_step(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    table.replace(spark.range(3))
    table.append(spark.range(3, 5))
    table.replace(table.read().filter("id > 1"))
    assert sorted(r.id for r in Table(spark, f"file://{tmp_path}/t").read().collect()) == [2, 3, 4]

    def fails(x):
        raise ValueError

    with pytest.raises(Exception):
        table.replace(spark.range(9).mapInPandas(lambda it: map(fails, it), "id long"))
    assert Table(spark, f"file://{tmp_path}/t").read().count() == 3
