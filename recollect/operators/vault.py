"""Notes drawn from events and rules: their types, routes, grouping, upkeep and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.text import excerpt, has_any, is_high_value_note, is_lesson, note_confidence, note_type, safe_file, safe_folder, slug, stable_id, strip
from ..functions.text import project_key as path_key
from ..functions.time import week_label
from .ranks import numbered

#: Confidence from which a note goes to its project at once.
DIRECT = 0.78


def project_folder(cwd: Column, project_key: Column) -> Column:
    """The last folder of the working directory, else the key without its last part."""
    last = F.element_at(F.split(F.regexp_replace(cwd, "/+$", ""), "/"), -1)
    return F.when(F.coalesce(last, F.lit("")) != "", safe_folder(last)).when(project_key.isNotNull(), safe_folder(F.regexp_replace(project_key, "-[^-]*$", "")))


def note_title(text: Column, kind: Column, limit: int = 60) -> Column:
    """The first line that says something: marks and prefixes taken off, bare headings left out; else a title by type."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[ #\-*]+|[ #\-*]+$", ""), r"(?i)^(please implement this plan:|总结：|计划：|需求：|决策：|复盘：|结论：)\s*", "")))
    fine = F.filter(lines, lambda x: (x != "") & ~F.lower(x).isin("summary", "key changes", "test plan", "assumptions") & (F.lower(x) != F.lower(kind)))
    return F.coalesce(F.when(F.size(fine) > 0, excerpt(F.try_element_at(fine, F.lit(1)), limit)), F.concat(kind, F.lit("记录")))


def _or_null(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


def note_block() -> Column:
    """What a note's file says of one event: title, summary, the text, and where it comes from."""
    known = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(F.col(c))
    facts = [("工具", F.coalesce("source_tool", F.lit(""))), ("角色", F.coalesce("role", F.lit(""))), ("会话", known("session_id")), ("时间", F.coalesce("timestamp", F.lit(""))), ("工作目录", known("cwd")), ("置信度", F.col("confidence").cast("string"))]
    lines = F.concat(*(F.concat(F.lit(f"- {name}: "), value, F.lit("\n")) for name, value in facts))
    return F.concat(F.lit("# "), "title", F.lit("\n\n## 摘要\n"), excerpt("text", 180), F.lit("\n\n## 内容\n"), strip(F.coalesce("text", F.lit(""))), F.lit("\n\n## 来源\n"), lines)


def notes(events: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = V.NOTE_TYPES, high_value: Column | None = None) -> DataFrame:
    """A note for each event of value that has a type: title, type, project, confidence, route, day, and its block of text."""
    rows = events.filter(is_high_value_note("text") if high_value is None else high_value).withColumn("note_type", note_type("text", rules)).filter("note_type is not null")
    rows = rows.withColumn("session_id", _or_null(events, "session_id")).withColumn("cwd", _or_null(events, "cwd")).withColumn("timestamp", F.regexp_replace("timestamp", "Z$", "+00:00"))
    rows = rows.withColumn("project_name", project_folder(F.col("cwd"), F.col("project_key"))).withColumn("confidence", note_confidence("text", "note_type", F.col("project_name").isNotNull(), "role"))
    direct = F.col("project_name").isNotNull() & (F.col("confidence") >= DIRECT) & (F.col("note_type") != "规则")
    rows = rows.withColumn("title", F.substring(note_title(F.col("text"), F.col("note_type")), 1, 48)).withColumn("route", F.when(direct, "project").otherwise("inbox"))
    key = F.coalesce("project_key", path_key("cwd"))
    return rows.select("id", "source_tool", "role", "text", "timestamp", "session_id", "cwd", key.alias("project_key"), "note_type", "project_name", "confidence", "title", "route", F.substring("timestamp", 1, 10).alias("day"), note_block().alias("block"))


#: What makes notes one note.
NOTE_KEY = ("day", "note_type", "project", "title_key")
#: Blocks of a note in one part of it.
PART = 50


def _keyed(found: DataFrame) -> DataFrame:
    return found.withColumn("project", F.coalesce("project_name", F.lit(""))).withColumn("title_key", F.lower("title"))


def grouped_notes(found: DataFrame) -> DataFrame:
    """Notes of one day, type, project and title as one: what the first of them says of title, project, route and source,
    the latest update, the greatest confidence and the tags of all. Its blocks are note_blocks."""
    mark = F.when(F.col("confidence") >= DIRECT, "高价值").otherwise("待整理")
    rows = _keyed(found).withColumn("source", F.concat_ws(":", "source_tool", "role"))
    first = F.min_by(F.struct("title", "project_key", "route", "source"), F.struct("timestamp", "id"))
    made = rows.groupBy(*NOTE_KEY).agg(
        F.count("*").alias("events"),
        F.min("timestamp").alias("created"),
        F.max("timestamp").alias("updated"),
        F.max("confidence").alias("confidence"),
        first.alias("f"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("source_tool", "role", "note_type", mark))))).alias("tags"),
    )
    return made.select(*NOTE_KEY, "events", "created", "updated", "confidence", "f.*", "tags", stable_id(F.lit("note"), *NOTE_KEY).alias("note_id"))


def note_blocks(found: DataFrame) -> DataFrame:
    """(note_id, part, body): the different blocks of each note in order, PART of them a row; a note's body is its parts one after the other."""
    rows = _keyed(found).select(stable_id(F.lit("note"), *NOTE_KEY).alias("note_id"), F.struct("timestamp", "id").alias("at"), "block")
    rows = rows.groupBy("note_id", F.sha2("block", 256).alias("_b")).agg(F.min("at").alias("at"), F.first("block").alias("block"))
    rows = numbered(rows, ["note_id"], ["at", "_b"], "_n").withColumn("part", F.floor((F.col("_n") - 1) / PART).cast("int") + 1)
    between = F.lit("\n\n---\n\n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "block"))), lambda x: x["block"]), "\n\n---\n\n")
    return rows.groupBy("note_id", "part").agg(text.alias("body")).select("note_id", "part", F.when(F.col("part") > 1, F.concat(between, "body")).otherwise(F.col("body")).alias("body"))


def rule_notes(items: DataFrame) -> DataFrame:
    """Active rules and profiles outside projects, each content once: the latest made, ties by id."""
    rows = items.filter((F.col("status") == "active") & (F.col("scope") != "project") & F.col("memory_type").isin("procedural", "profile") & ~F.array_contains("tags", "needs-review"))
    rows = rows.withColumn("content_key", F.substring(F.sha1(F.concat_ws("||", "title", "summary", "details")), 1, 24))
    rest = [c for c in rows.columns if c != "content_key"]
    return rows.groupBy("content_key").agg(F.max_by(F.struct(*rest), F.struct("created_at", -F.col("id") if dict(items.dtypes)["id"] != "string" else F.col("id"))).alias("r")).select("content_key", "r.*")


def paths(found: DataFrame) -> DataFrame:
    """A file path for each note; equal ones get -2, -3 and so on, in the order of their ids."""
    folder = F.when(F.col("route") == "project", F.concat(F.lit("projects/"), F.col("project_name"), F.lit("/"))).otherwise("inbox/")
    rows = found.withColumn("_p", F.concat(folder, slug("title")))
    n = F.row_number().over(Window.partitionBy("_p").orderBy("id"))
    return rows.withColumn("path", F.concat(F.col("_p"), F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".md"))).drop("_p")


def _quoted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}: "'), F.coalesce(value.cast("string"), F.lit("")), F.lit('"'))


def frontmatter() -> Column:
    """The head of a note's file, from its columns project, project_key, type, status, source, tags, created, updated and confidence."""
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.array_join(F.transform("tags", lambda t: F.concat(F.lit("  - "), t)), "\n"))
    strings = [_quoted(n, F.col(n)) for n in ("project", "project_key", "type", "status", "source")]
    return F.concat_ws("\n", *strings, F.lit("tags:"), tags, _quoted("created", F.col("created")), _quoted("updated", F.col("updated")), _quoted("confidence", F.round("confidence", 3)), F.lit(""))


def conversation_files(found: DataFrame) -> DataFrame:
    """Notes with the columns of `files`, a row for each part: those of sure types of a project go there, reviews to their folder, the rest to the inbox."""
    grouped = grouped_notes(found)
    direct = (F.col("route") == "project") & F.col("note_type").isin(*V.NOTE_FOLDERS)
    folder = F.element_at(F.create_map(*(F.lit(x) for kv in V.NOTE_FOLDERS.items() for x in kv)), F.col("note_type"))
    where = F.when(direct, F.concat_ws("/", F.lit("projects"), "project", folder)).when(F.col("note_type") == "复盘", "reviews").otherwise("inbox")
    heads = grouped.select(
        F.col("note_id").alias("id"), "title", where.alias("folder"), "project", F.coalesce("project_key", F.lit("")).alias("project_key"), F.col("note_type").alias("type"),
        F.when(F.col("route") == "project", "draft").otherwise("inbox").alias("status"), "source", "tags", "created", "updated", "confidence",
    )
    return heads.join(note_blocks(found).withColumnRenamed("note_id", "id"), "id")


def rule_files(rules: DataFrame) -> DataFrame:
    """Rule notes with the columns of `files`, one part each: title, summary, details and the first five pieces of evidence. Times are given as ISO strings."""
    held = F.filter(F.slice(F.coalesce("evidence", F.array()), 1, 5), lambda e: F.coalesce(e["excerpt"], F.lit("")) != "")
    lines = F.array_join(F.transform(held, lambda e: F.concat(F.lit("- "), F.coalesce(e["source_tool"], F.lit("")), F.lit(": "), excerpt(e["excerpt"], 120))), "\n")
    text = lambda c: F.coalesce(c, F.lit(""))
    body = F.concat(F.lit("# "), text("title"), F.lit("\n\n## 摘要\n"), text("summary"), F.lit("\n\n## 说明\n"), text("details"), F.lit("\n\n## 证据\n"), F.when(lines == "", "- 暂无证据摘要").otherwise(lines), F.lit("\n"))
    tags = F.array_sort(F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(V.RULE_TAG), F.col("memory_type")))))
    updated = F.coalesce("last_seen_at", _or_null(rules, "reviewed_at"), "created_at")
    return rules.select(
        F.col("id").cast("string").alias("id"), F.substring(note_title(F.col("title"), F.lit("规则")), 1, 48).alias("title"), F.lit("rules").alias("folder"), F.lit("").alias("project"), F.lit("").alias("project_key"),
        F.lit("规则").alias("type"), F.lit("active").alias("status"), F.concat(F.lit(V.RULE_SOURCE), "tool").alias("source"), tags.alias("tags"), F.col("created_at").alias("created"),
        updated.alias("updated"), "confidence", F.lit(1).alias("part"), body.alias("body"),
    )


def files(found: DataFrame) -> DataFrame:
    """(id, path, part, content): a file for each note, named by day, type and title (80 characters of it); equal names get
    -2, -3 and so on, in the order of ids, which are unique. A file is the contents of its parts one after the other."""
    folder = F.concat("folder", F.lit("/"), F.substring("created", 1, 10), F.lit("_"), "type", F.lit("_"), safe_file(F.coalesce("title", F.lit(""))))
    rows = found.withColumn("_p", folder)
    places = numbered(rows.filter("part = 1").select("id", "_p", F.col("id").try_cast("long").alias("_id")), ["_p"], ["_id", "id"], "_n")
    path = F.concat("_p", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""), F.lit(".md"))
    head = F.when(F.col("part") == 1, F.concat(F.lit("---\n"), frontmatter(), F.lit("---\n\n"))).otherwise("")
    return rows.drop("_p").join(places.select("id", path.alias("path")), "id").select("id", "path", "part", F.concat(head, "body").alias("content"))


def imported(notes_: DataFrame, known: DataFrame, least: int = 80, markers: Sequence[str] = V.IMPORT_MARKERS) -> DataFrame:
    """Memories out of notes written by hand (note_id, title, text) whose note_id isn't known: long enough and with a word of value.

    The id comes from title and text, so a note that was moved gives the id it had.
    """
    fresh = notes_.join(known.select("note_id"), "note_id", "left_anti").withColumn("_b", strip(F.coalesce("text", F.lit(""))))
    fresh = fresh.filter((F.length("_b") >= least) & has_any("_b", markers))
    title, summary = F.substring("title", 1, 36), F.substring("_b", 1, 72)
    return fresh.select(
        stable_id(F.lit("semantic"), F.lit("global"), F.lit("shared"), F.lower(title), F.lower(summary)).alias("id"), "note_id", title.alias("title"),
        F.lit("semantic").alias("memory_type"), F.lit("global").alias("scope"), F.lit("shared").alias("tool"), summary.alias("summary"), F.substring("_b", 1, 400).alias("details"),
        F.substring("_b", 1, 220).alias("excerpt"), F.lit(0.92).alias("confidence"), F.lit(0.95).alias("stability"), F.lit("low").alias("sensitivity"),
        F.array(*map(F.lit, ("obsidian-import", "high-confidence", "needs-review"))).alias("tags"), F.lit("candidate").alias("status"), F.lit(90).alias("expiration_days"),
    )


def pending(found: DataFrame, as_of: Column, days: int = 7, modified: str = "modified_at") -> DataFrame:
    """Notes in the inbox that nobody touched for so many days."""
    return found.filter((F.col("route") == "inbox") & (F.unix_timestamp(F.col(modified)) <= F.unix_timestamp(as_of) - days * 86400))


def weekly(found: DataFrame, ts: str = "created_at") -> DataFrame:
    """(week, type, count): what came up in each ISO week."""
    return found.groupBy(week_label(ts).alias("week"), F.col("memory_type").alias("type")).agg(F.count("*").alias("count"))


def ranked_summaries(items: DataFrame, limit: int = 12) -> DataFrame:
    """The latest, surest and steadiest summaries as bullets of 120 characters, each once, no case."""
    seen = F.coalesce("last_seen_at", "created_at")
    rows = items.withColumn("bullet", excerpt("summary", 120)).filter("bullet <> ''")
    best = rows.groupBy(F.lower("bullet").alias("k")).agg(F.max_by(F.struct("bullet", seen.alias("seen"), "confidence", "stability", "id"), F.struct(seen, "confidence", "stability", -F.col("id"))).alias("b"))
    return best.select("b.*").orderBy(F.desc("seen"), F.desc("confidence"), F.desc("stability"), "id").limit(limit)


def brief(items: DataFrame, sections: Column, most: int = 8) -> DataFrame:
    """(section, rank, line): a brief for a tool, by certainty within each section."""
    rows = items.withColumn("section", sections).filter("section is not null")
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("confidence"), F.desc("stability"), "title", "id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= most).select("section", "rank", "id", F.concat(F.lit("- "), F.col("title")).alias("line"))


def current_project(items: DataFrame) -> DataFrame:
    """One row: the project that was seen last."""
    seen = F.coalesce("last_seen_at", "created_at")
    return items.filter("project_key is not null").groupBy("project_key").agg(F.max(seen).alias("seen")).orderBy(F.desc("seen"), "project_key").limit(1)


def _bullets(rows: DataFrame, most: int) -> DataFrame:
    """One row, `items`: the first `most` different bullets (no case) of rows (text, at, id), the latest first."""
    cut = rows.withColumn("bullet", excerpt("text", 120)).filter("bullet <> ''")
    each = cut.groupBy(F.lower("bullet").alias("_k")).agg(F.max_by("bullet", "at").alias("bullet"), F.max("at").alias("at"))
    first = each.orderBy(F.desc("at"), "_k").limit(most)
    return first.agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("at", F.reverse("_k").alias("_r"), "bullet")))), lambda x: x["bullet"]).alias("items"))


def weekly_documents(items: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """(name, content) of the two documents that sum up a week: habits and preferences, and lessons learned.

    items: active memories; found: notes (timestamp, title, note_type, project_name, confidence, route). Habits are what
    profiles and procedures outside projects said in 45 days, lessons what concrete rules and patterns said in 60; notes
    are those of the last 7 days. Each list is the latest few bullets, cut before it is gathered.
    """
    seen = F.coalesce(*(c for c in ("last_seen_at", "reviewed_at", "created_at") if c in items.columns))
    since = lambda c, days: F.unix_timestamp(F.to_timestamp(c)) >= F.unix_timestamp(as_of) - days * 86400
    outside = items.filter((F.col("status") == "active") & (F.col("scope") != "project"))
    tagged = lambda *tags: F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    pieces = F.size(F.coalesce("evidence", F.array())) if "evidence" in items.columns else F.lit(0)
    ranked = lambda rows: rows.select(F.col("summary").alias("text"), F.struct(seen.cast("string").alias("s"), "confidence", "stability", pieces.alias("n")).alias("at"))
    habits = ranked(outside.filter(F.col("memory_type").isin("profile", "procedural") & tagged("preference", "rule", "procedure") & since(seen, 45)))
    patterns = ranked(outside.filter(F.col("memory_type").isin("procedural", "semantic") & tagged("watchout", "rule", "semantic") & since(seen, 60) & is_lesson("summary")))
    late = found.filter(since("timestamp", 7)).withColumn("text", F.col("title")).withColumn("at", F.struct(F.col("timestamp").alias("s"), F.col("confidence").alias("c")))
    new = late.filter(F.col("note_type").isin("规则", "计划", "需求"))
    learned = late.filter(F.col("note_type").isin("复盘", "决策") & is_lesson("title") & (F.col("project_name").isNotNull() | (F.col("confidence") >= 0.82)))
    lists = {"habits": (habits, 8), "new": (new, 8), "open": (new.filter("route = 'inbox'"), 6), "gains": (learned.filter("note_type = '决策'"), 8), "risks": (learned.filter("note_type = '复盘'"), 8), "patterns": (patterns, 10)}
    row = None
    for name, (rows, most) in lists.items():
        one = _bullets(rows.select("text", "at"), most).withColumnRenamed("items", name)
        row = one if row is None else row.join(one)
    shown = lambda name, none: F.when(F.size(name) > 0, F.array_join(F.transform(name, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(f"- {none}")
    week = week_label(as_of)
    documents = []
    for (name, title), sections, rules in V.WEEKLY_DOCUMENTS:
        parts = [F.lit(f"# {title}")]
        for heading, key, none in sections:
            parts.append(F.concat(F.lit("\n## "), F.replace(F.lit(heading), F.lit("{week}"), week), F.lit("\n"), shown(key, none)))
        parts.append(F.lit("\n## 更新规则\n" + "\n".join(f"- {r}" for r in rules) + "\n"))
        documents.append(F.struct(F.lit(name).alias("name"), F.concat_ws("\n", *parts).alias("content")))
    return row.select(F.explode(F.array(*documents)).alias("d")).select("d.*")
