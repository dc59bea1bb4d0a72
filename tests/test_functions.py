import hashlib
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.functions import time as TM
from recollect.functions.similarity import length_bound, ratio


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, x string" + (", y string" if isinstance(rows[0], tuple) else ""))
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("i").select(*columns).collect()]


def test_excerpt_and_ids(spark):
    assert values(spark, ["  a \n b ", None, "x" * 10, "x" * 11], X.excerpt("x", 10)) == ["a b", "", "x" * 10, "x" * 7 + "..."]
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()[:16]
    assert values(spark, [(" a ", "b"), ("a", None), ("a", "")], X.stable_id("x", "y")) == [sha("a||b"), sha("a"), sha("a||")]


def test_slugs_and_projects(spark):
    assert values(spark, [" My Project_01 ", "--", "é"], X.slug("x")) == ["my-project-01", "item", "item"]
    key = hashlib.sha1(b"/u/my proj").hexdigest()[:16]
    assert values(spark, ["/u/my proj/", "", None], X.project_key("x")) == [f"my-proj-{key}", None, None]
    assert values(spark, ["abc-0123456789abcdef", "Label", "/u/my proj"], X.project_reference("x")) == ["abc-0123456789abcdef", "Label", f"my-proj-{key}"]
    assert values(spark, ["my_api-0123456789abcdef", "SQL tool"], X.clean_project_label("x")) == ["My Api", "SQL Tool"]


@pytest.mark.parametrize(
    ("text", "garbled"),
    [("clean text", False), (None, False), ("锟斤拷", True), ("wh????", True), ("wor?ld", False), ("what? yes", True), ("end?", True), ("字?", True), ("1? ", False)],
)
def test_garbled(spark, text, garbled):
    assert values(spark, [text], X.is_garbled("x")) == [garbled]


def test_low_value(spark):
    cases = {
        "": True, "short": True, "short must": True, "a long enough sentence": False, "# heading of text": True, "- a bullet without the word": True,
        "- a bullet that must stay": False, "/usr/local/lib/python": True, "we return the value here": True, "returning the values here": False,
        "问题 这里有一些": True, "please implement this plan now": True, "x -> y mapping here": True, "帮我 do this and that": True,
    }
    assert dict(zip(cases, values(spark, list(cases), X.is_low_value("x", ["must"])), strict=True)) == cases | {"short must": False}


def test_polarity_and_notes(spark):
    assert values(spark, ["always do", "never do", "always never", "do"], X.polarity("x")) == [1, -1, 0, 0]
    assert values(spark, ["总结 教训 plan", "plan 总结", "nothing", "plan roadmap 总结"], X.note_type("x")) == ["复盘", "复盘", None, "计划"]


def test_code_blocks(spark):
    got = values(spark, ["a ```py\nx = 1\n``` b ```\ny\n```", "none"], X.code_blocks("x"))
    assert [[(c.lang, c.code.strip()) for c in row] for row in got] == [[("py", "x = 1"), ("code", "y")], []]


def test_times(spark):
    n = TM.normalize("x")
    rows = ["1700000000", "1700000000000", "2023-11-14T22:13:20Z", "2023-11-14T22:13:20+00:00", "2023-11-15T00:13:20+02:00", "soon", "", None, "9" * 30]
    got = values(spark, rows, n["value"], n["changed"], n["error"])
    iso = "2023-11-14T22:13:20+00:00"
    assert got == [(iso, True, None), (iso, True, None), (iso, True, None), (iso, False, None), (iso, True, None), ("soon", False, "unparseable_timestamp"), ("", False, None), (None, False, None), ("9" * 30, False, "unparseable_unix_timestamp")]


def test_labels(spark):
    rows = ["2024-12-30 10:00:00", "2021-01-03 00:00:00", "2024-05-31 23:59:59"]
    t = F.to_timestamp("x")
    assert values(spark, rows, TM.week_label(t), TM.month_label(t), TM.quarter_label(t)) == [("2025-W01", "2024-12", "2024-Q4"), ("2020-W53", "2021-01", "2021-Q1"), ("2024-W22", "2024-05", "2024-Q2")]
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    assert values(spark, ["2024-05-31 00:00:01", "2024-05-30 12:00:00", None], TM.time_ago(F.to_timestamp("x"), now)) == ["今天", "1天前", "未知"]


def test_times_to_come(spark):
    now, rows = F.to_timestamp(F.lit("2024-06-01 00:00:00")), ["2024-05-31 00:00:00", "2024-06-01 00:00:00", "2024-06-01 01:00:00", "2024-06-02 00:00:00", "2024-06-03 23:00:00"]
    got = values(spark, rows, TM.time_ago(F.to_timestamp("x"), now), TM.time_ago(F.to_timestamp("x"), now, to_zero=True))
    assert got == [("1天前", "1天前"), ("今天", "今天"), ("-1天前", "今天"), ("-1天前", "-1天前"), ("-3天前", "-2天前")]


def test_time_ago_against_sql(spark, tmp_path):
    """Memories from before and after the day of the query, and one without an id."""
    import duckdb

    from recollect.plans import catalog

    rows = [(i, "a text", "en", "s", 6) for i in (0, 3623, 3624, 3625, 3647, 3648, 3649, 3671, 3672, 3673, 9999, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES["time_ago"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.sql(catalog.ORACLE_SQL["time_ago"]).fetchall()))


def test_ratio(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("Abc", "aBC"), ("a" * 300 + "b", "b" + "a" * 300), (None, "x")]
    want = [SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio() for a, b in pairs]
    got = values(spark, pairs, ratio("x", "y"), length_bound(F.coalesce("x", F.lit("")), F.coalesce("y", F.lit(""))))
    assert [g[0] for g in got] == want and all(r <= b + 1e-12 for r, b in got)


def test_accents_are_folded_in_searches(spark):
    from recollect.functions.text import count_terms, query_terms, tokens
    from recollect.operators import search

    row = spark.range(1).select(tokens(F.lit("Naïve CAFÉ café Straße Ñandú ệ 日本 йод")).alias("t"), count_terms(F.lit("café Cafe cafés"), ["cafe"]).alias("n")).first()
    assert row.t == ["naive", "cafe", "cafe", "straße", "nandu", "e", "日本", "йод"] and row.n == [3, 2]
    assert query_terms("Naïve naive ÉTÉ_x") == ["naive", "ete", "x"]
    items = spark.createDataFrame([(1, "a naïve view", "", "", []), (2, "other", "", "", [])], "id int, title string, summary string, details string, tags array<string>")
    for query in ("naive", "NAÏVE"):
        assert [r.id for r in search.bm25(items, query).collect()] == [1]
