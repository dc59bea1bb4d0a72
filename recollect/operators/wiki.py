"""Topic, project and type pages of memories, their upkeep, and the lint of what they say."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.similarity import common_letters, common_subsequence, letter_counts, ratio
from ..functions.text import clean_project_label, excerpt, is_poor_project_name, polarity, slug, token_set
from ..sources.model import stored
from .ranks import dealt, numbered

#: A topic with so many memories and summaries shorter than this on average is too broad.
BROAD_ITEMS, BROAD_SUMMARY = 8, 80
#: Evidence of fewer characters than this is weak.
WEAK = 16
#: Memories of one side of a conflict in a row, about.
MEMBERS = 1000
#: Entries of a page in one part of it.
PART = 200
#: Titles in a block; two blocks are compared in one task.
TILE = 512


def topic_tags() -> Column:
    return F.array_except(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, V.GENERIC_TAGS)))


def with_topics(items: DataFrame) -> DataFrame:
    """A row for each memory and topic tag of its own."""
    return items.withColumn("topic", F.explode(F.array_distinct(topic_tags())))


def topics(items: DataFrame, least: int = 2) -> DataFrame:
    """(topic, items): tags of at least two memories that aren't generic."""
    return with_topics(items).groupBy("topic").agg(F.count("*").alias("items")).filter(F.col("items") >= least)


def project_names(items: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """(project_key, display_name, source, low_quality): the configured name, else one that the surest memory mentions
    after `project` or `repo`, else the cleaned key, else the key. configured: (project_key, name)."""
    rows = items.filter("project_key is not null")
    said = F.lit(None).cast("string")
    for c in ("details", "summary", "title"):
        for word in ("repo", "project"):
            label = clean_project_label(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i)\b{word}[: \t\n]+([A-Za-z0-9 _-]{{3,40}})", 1))
            said = F.when(F.length(label) >= 3, label).otherwise(said)
    rows = rows.withColumn("_said", said)
    best = rows.groupBy("project_key").agg(F.min_by("_said", F.when(F.col("_said").isNotNull(), F.struct((-F.col("confidence")).alias("c"), "title", "id"))).alias("said"))
    if configured is not None:
        best = best.join(configured.select("project_key", "name"), "project_key", "left")
    else:
        best = best.withColumn("name", F.lit(None).cast("string"))
    inferred = F.coalesce("said", F.nullif(clean_project_label("project_key"), F.lit("")))
    fits = inferred.isNotNull() & (F.lower(inferred) != F.lower("project_key"))
    named = F.coalesce("name", F.lit("")) != ""
    out = best.select(
        "project_key",
        F.when(named, F.trim("name")).when(fits, inferred).otherwise(F.col("project_key")).alias("display_name"),
        F.when(named, "bootstrap_projects").when(fits, "memory_or_key_inference").otherwise("project_key_fallback").alias("source"),
    )
    return out.withColumn("low_quality", is_poor_project_name("project_key", "display_name"))


def link(target: Column, label: Column | None = None) -> Column:
    if label is None:
        return F.concat(F.lit("[["), target, F.lit("]]"))
    return F.when((label != "") & (label != target), F.concat(F.lit("[["), target, F.lit("|"), label, F.lit("]]"))).otherwise(F.concat(F.lit("[["), target, F.lit("]]")))


def record_line(project: str = "project_key") -> Column:
    """A memory as a list entry: title, type, confidence, project (under the name in a column), up to four topics, and its summary below."""
    shown = F.transform(F.slice(topic_tags(), 1, 4), lambda t: link(F.concat(F.lit("topics/"), slug(t)), t))
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("- **"), F.col("title"), F.lit("**")),
            F.concat(F.lit("type: `"), F.col("memory_type"), F.lit("`")),
            F.concat(F.lit("conf: `"), F.format_string("%.2f", F.col("confidence")), F.lit("`")),
            F.when(F.col("project_key").isNotNull(), F.concat(F.lit("project: "), link(F.concat(F.lit("projects/"), F.col("project_key"), F.lit("/index")), F.coalesce(project, "project_key")))),
            F.when(F.size(shown) > 0, F.concat(F.lit("topics: "), F.array_join(shown, ", "))),
        )
    )
    return F.concat(F.array_join(parts, "  "), F.lit("\n  "), excerpt("summary", 180))


def page_keys(items: DataFrame) -> DataFrame:
    """(id, page_key): the pages on which each memory stands: its type, its project, and its topics of two memories or more."""
    base = items.select("id", F.explode(F.array_compact(F.array(F.concat(F.lit("types/"), F.col("memory_type")), F.when(F.col("project_key").isNotNull(), F.concat(F.lit("projects/"), F.col("project_key"), F.lit("/index")))))).alias("page_key"))
    by_topic = with_topics(items).select("id", "topic").join(topics(items).select("topic"), "topic").select("id", F.concat(F.lit("topics/"), slug("topic")).alias("page_key"))
    return base.unionByName(by_topic)


def page_entries(items: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(page_key, entry_no, id, line): all entries of each page, surest and steadiest first; a page is written from its entries in order.

    names: (project_key, display_name), under which entries link their projects.
    """
    named = items.withColumn("_name", F.col("project_key")) if names is None else items.join(names.select("project_key", F.col("display_name").alias("_name")), "project_key", "left")
    rows = page_keys(items).join(named.select("id", "title", "confidence", "stability", record_line("_name").alias("line")), "id")
    return numbered(rows, ["page_key"], [F.desc("confidence"), F.desc("stability"), "title", "id"]).select("page_key", "entry_no", "id", "line")


def _part(number: str) -> Column:
    """The part of a page in which its entry of a number stands."""
    return F.floor((F.col(number) - 1) / PART).cast("int") + 1


def _joined(column: str) -> Column:
    """The lines of a group (structs of a place and a line), in their order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", column))), lambda x: x[column]), "\n")


def _code(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: `"), value.cast("string"), F.lit("`"))


def _from(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def issue_message() -> Column:
    said = F.replace(_from(V.ISSUE_MESSAGES, F.col("issue_type")), F.lit("{}"), F.col("subject"))
    return F.replace(said, F.lit("{other}"), F.coalesce("other", F.lit("None")))


def _first(rows: DataFrame, by: str, most: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= most)


def page_heads(items: DataFrame, names: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """(page_key, title, head): what stands above the entries of each type's, project's and topic's page.

    A project's head names it, its first 12 topics and its first 6 issues; a topic's counts its projects and links the
    first 8. Lists are cut before they are gathered. Topics that share a slug share a page, under the last one's name.
    """
    total = F.count("*").alias("n")
    kinds = items.groupBy("memory_type").agg(total).select(
        F.concat(F.lit("types/"), "memory_type").alias("page_key"),
        F.coalesce(_from(V.TYPE_LABELS, F.col("memory_type")), F.initcap("memory_type")).alias("title"),
        F.concat(F.lit("Generated from `"), F.col("n").cast("string"), F.lit("` active memories.\n\n## Related\n- "), link(F.lit("index"), F.lit("Wiki Home"))).alias("head"),
    )
    owned = items.filter("project_key is not null")
    topic = F.concat(F.lit("- "), link(F.concat(F.lit("topics/"), slug("topic")), F.col("topic")))
    related = _first(with_topics(owned).select("project_key", "topic").distinct(), "project_key", 12, "topic")
    related = related.withColumn("line", topic).groupBy("project_key").agg(_joined("line").alias("related"))
    projects = owned.groupBy("project_key").agg(total).join(names, "project_key").join(related, "project_key", "left")
    projects = projects.withColumn("page_key", F.concat(F.lit("projects/"), F.col("project_key"), F.lit("/index")))
    if issues is None:
        projects = projects.withColumn("warnings", F.lit(None).cast("string"))
    else:
        warned = page_warnings(issues).withColumn("line", F.concat(F.lit("- `"), F.col("issue_type"), F.lit("` "), issue_message()))
        projects = projects.join(warned.withColumnRenamed("warning_no", "_n").groupBy("page_key").agg(_joined("line").alias("warnings")), "page_key", "left")
    about = F.concat_ws("\n", F.lit("## Summary"), _code("Display name", F.col("display_name")), _code("Project key", F.col("project_key")), _code("Active memories", F.col("n")), _code("Name source", F.col("source")))
    warnings = F.concat(F.lit("\n\n## Governance Warnings\n"), F.col("warnings"))
    projects = projects.select(
        "page_key",
        F.concat(F.lit("Project "), "display_name").alias("title"),
        F.concat(about, F.lit("\n\n## Related Topics\n"), F.coalesce("related", F.lit("- No topic pages yet.")), F.coalesce(warnings, F.lit(""))).alias("head"),
    )
    tagged = with_topics(items).join(topics(items).select("topic"), "topic").withColumn("page_key", F.concat(F.lit("topics/"), slug("topic")))
    counts = tagged.groupBy("page_key").agg(F.countDistinct("id").alias("n"), F.countDistinct("project_key").alias("projects"), F.max("topic").alias("topic"))
    linked = _first(tagged.filter("project_key is not null").select("page_key", "project_key").distinct(), "page_key", 8, "project_key").join(names, "project_key")
    linked = linked.withColumn("line", link(F.concat(F.lit("projects/"), F.col("project_key"), F.lit("/index")), F.col("display_name"))).groupBy("page_key").agg(F.replace(_joined("line"), F.lit("\n"), F.lit(", ")).alias("linked"))
    of_topics = counts.join(linked, "page_key", "left").select(
        "page_key",
        F.concat(F.lit("Topic "), "topic").alias("title"),
        F.concat_ws("\n", F.lit("## Summary"), _code("Active memories", F.col("n")), _code("Unique projects", F.col("projects")), F.lit("\n## Related"), F.concat(F.lit("- "), link(F.lit("index"), F.lit("Wiki Home"))), F.concat(F.lit("- Projects: "), F.col("linked"))).alias("head"),
    )
    return kinds.unionByName(projects).unionByName(of_topics)


def pages(items: DataFrame, configured: DataFrame | None = None, issues: DataFrame | None = None) -> DataFrame:
    """(page_key, part, content, sha1): the pages of types, projects and topics in Markdown, with all their entries.

    A page is the contents of its parts (from 1) one after the other. The first part has the head, every part PART
    entries at most, so that no row and no task grows with a page.
    """
    names = project_names(items, configured)
    bodies = page_entries(items, names).withColumn("part", _part("entry_no")).withColumnRenamed("entry_no", "_n").groupBy("page_key", "part").agg(_joined("line").alias("entries"))
    heads = page_heads(items, names, issues).withColumn("part", F.lit(1))
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("head"), F.lit("\n\n## Entries\n"))
    text = F.concat(F.coalesce(head, F.lit("")), F.col("entries"), F.lit("\n"))
    return bodies.join(heads, ["page_key", "part"], "left").select("page_key", "part", text.alias("content")).withColumn("sha1", F.sha1("content"))


def front_pages(items: DataFrame, issues: DataFrame, configured: DataFrame | None = None, named: int = 20, shown: int = 10) -> DataFrame:
    """(page_key, part, content, sha1) of two pages: the index, which links all projects by name (PART of them a part) and
    the first 24 topics, and the health page with the counts of issues, the first `named` poor names and `shown` issues of
    each type, with up to three sample titles (issues.samples, if there) and what is suggested."""
    names = project_names(items, configured).filter("project_key <> ''")
    one = lambda rows, line, name: rows.agg(_joined(line).alias(name))
    place = lambda rows, n, *order: rows.orderBy(*order).limit(n).withColumn("_n", F.struct(*order))
    bullet = lambda target, label: F.concat(F.lit("- "), link(target, label))
    key = F.concat(F.lit("projects/"), F.col("project_key"), F.lit("/index"))
    linked = names.select(F.lit("index").alias("page_key"), F.lower("display_name").alias("_low"), "project_key", bullet(key, F.col("display_name")).alias("line"))
    linked = numbered(linked, ["page_key"], ["_low", "project_key"], "_n")
    listed = linked.withColumn("part", _part("_n")).groupBy("page_key", "part").agg(_joined("line").alias("projects"))
    tags = topics(items)
    few = one(place(tags, 24, "topic").withColumn("line", bullet(F.concat(F.lit("topics/"), slug("topic")), F.col("topic"))), "line", "topics")
    total = items.agg(F.count("*").alias("n"))
    or_else = lambda c, text: F.when(F.coalesce(c, F.lit("")) == "", text).otherwise(F.col(c))
    types = [bullet(F.lit(f"types/{k}"), F.lit(v)) for k, v in V.TYPE_LABELS.items()]
    overview = [F.lit("# Memory Wiki\n\n## Overview"), _code("Active memories", F.col("n")), *types, bullet(F.lit("health"), F.lit("Wiki Health"))]
    last = F.greatest(F.ceil(F.count("*") / PART), F.lit(1)).cast("int")
    around = total.join(F.broadcast(few)).join(F.broadcast(names.agg(last.alias("last"))))
    every = F.explode(F.sequence(F.lit(1), "last"))
    above = F.when(F.col("part") == 1, F.concat_ws("\n", *overview, F.lit("\n## Projects\n")))
    below = F.when(F.col("part") == F.col("last"), F.concat_ws("\n", F.lit("\n## Topics"), or_else("topics", "- No topic pages yet."), F.lit("")))
    index = around.withColumn("part", every).join(listed.drop("page_key"), "part", "left").select(
        F.lit("index").alias("page_key"), "part", F.concat(F.coalesce(above, F.lit("")), or_else("projects", "- No project pages yet."), F.lit("\n"), F.coalesce(below, F.lit(""))).alias("content")
    )
    kinds = page_keys(items).select("page_key").distinct().agg(*(F.count_if(F.col("page_key").startswith(f"{k}s/")).alias(k) for k in ("type", "project", "topic")))
    by_type = issues.groupBy("issue_type").agg(F.count("*").alias("c")).withColumn("_n", F.col("issue_type"))
    counts = one(by_type.withColumn("line", F.concat(F.lit("- `"), F.col("issue_type"), F.lit("`: `"), F.col("c").cast("string"), F.lit("`"))), "line", "counts")
    poor = place(names.filter("low_quality"), named, "project_key")
    poor = one(poor.withColumn("line", F.concat(F.lit("- `"), F.col("project_key"), F.lit("` -> `"), F.col("display_name"), F.lit("` via `"), F.col("source"), F.lit("`; consider adding a clearer bootstrap project name."))), "line", "poor")
    samples = F.concat(F.lit("\n  Samples: "), F.array_join(F.slice("samples", 1, 3), ", ")) if "samples" in issues.columns else F.lit(None)
    said = [F.concat(F.lit("- "), issue_message()), samples, F.concat(F.lit("\n  Suggested action: "), _from(V.ISSUE_ACTIONS, F.col("issue_type")))]
    order = [c for c in ("subject", "other") if c in issues.columns]
    detail = _first(issues, "issue_type", shown, *order).withColumn("line", F.concat_ws("", *said))
    detail = detail.groupBy("issue_type").agg(_joined("line").alias("lines")).select(F.col("issue_type").alias("_n"), F.concat(F.lit("### "), F.col("issue_type"), F.lit("\n"), F.col("lines")).alias("line"))
    detail = one(detail, "line", "detail")
    section = lambda c, heading: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n## {heading}\n"), F.col(c)))
    facts = total
    for part in (kinds, counts, poor, detail):
        facts = facts.join(F.broadcast(part))
    health = facts.select(
        F.lit("health").alias("page_key"),
        F.lit(1).alias("part"),
        F.concat_ws(
            "\n", F.lit("# Wiki Health\n\n## Summary"), _code("Active memories", F.col("n")), *(_code(f"{k.capitalize()} pages", F.col(k)) for k in ("type", "project", "topic")),
            F.lit("\n## Issue Counts"), or_else("counts", "- No issues detected."), section("poor", "Low Quality Project Names"), section("detail", "Issues By Type"), F.lit(""),
        ).alias("content"),
    )
    return index.unionByName(health).withColumn("sha1", F.sha1("content"))


def orphan_pages(kept: DataFrame, items: DataFrame) -> DataFrame:
    """Issues for pages that are kept (page_key) but that no memory asks for any more."""
    wanted = page_keys(items).select("page_key")
    stale = kept.filter(~F.col("page_key").isin("index", "health")).select("page_key").distinct().join(wanted, "page_key", "left_anti")
    return stale.select(F.lit("orphan_page").alias("issue_type"), F.lit("medium").alias("severity"), F.col("page_key").alias("subject"), F.lit(None).cast("string").alias("other"), "page_key")


def changed_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_key, part, change): parts of pages that are new, changed or stale, by content hash; nothing else is written again."""
    at = ["page_key", "part"]
    b, a = before.select(*at, F.col("sha1").alias("b")), after.select(*at, F.col("sha1").alias("a"))
    joined = b.join(a, at, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return joined.select(*at, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "stale").otherwise("changed").alias("change"))


def affected_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages that a change of memories touches: those on which changed, new and vanished memories stand, before or after."""
    cols = ["title", "summary", "memory_type", "project_key", "tags", "confidence", "stability"]
    b, a = before.select("id", F.struct(*cols).alias("b")), after.select("id", F.struct(*cols).alias("a"))
    touched = b.join(a, "id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("id")
    keys = page_keys(before).unionByName(page_keys(after))
    return keys.join(touched, "id", "left_semi").select("page_key").distinct()


def weak_evidence(items: DataFrame, evidence: Column | None = None) -> DataFrame:
    """Memories whose evidence has fewer than WEAK characters altogether. evidence: its length, from the evidence column unless given."""
    if evidence is None:
        evidence = F.aggregate(F.coalesce(F.transform("evidence", lambda e: F.length(F.trim(F.coalesce(e["excerpt"], F.lit(""))))), F.array().cast("array<int>")), F.lit(0), lambda s, x: s + x)
    return items.filter(F.coalesce(evidence, F.lit(0)) < WEAK).select(F.lit("weak_evidence").alias("issue_type"), F.lit("medium").alias("severity"), F.col("id").cast("string").alias("subject"), F.lit(None).cast("string").alias("other"))


def missing_project(items: DataFrame) -> DataFrame:
    return items.filter((F.col("scope") == "project") & F.col("project_key").isNull()).select(F.lit("missing_project_key").alias("issue_type"), F.lit("high").alias("severity"), F.col("id").cast("string").alias("subject"), F.lit(None).cast("string").alias("other"))


def broad_topics(items: DataFrame, least: int = BROAD_ITEMS, short: int = BROAD_SUMMARY) -> DataFrame:
    """(topic, items, avg_summary) of topics with many memories and short summaries."""
    return with_topics(items).groupBy("topic").agg(F.count("*").alias("items"), F.avg(F.length(F.trim("summary"))).alias("avg_summary")).filter((F.col("items") >= least) & (F.col("avg_summary") < short))


def lint_report(items: DataFrame, evidence: Column | None = None, least: int = BROAD_ITEMS, short: int = BROAD_SUMMARY) -> DataFrame:
    """All issues that need no pairs, in one table (issue_type, severity, subject, other, page_key): weak evidence, missing
    projects, topics too broad, and orphans, which stand on no topic's and no project's page."""
    topic = broad_topics(items, least, short).select(F.lit("overbroad_topic").alias("issue_type"), F.lit("medium").alias("severity"), F.col("topic").alias("subject"), F.lit(None).cast("string").alias("other"))
    placed = page_keys(items).filter(~F.col("page_key").startswith("types/")).select("id").distinct()
    orphans = items.join(placed, "id", "left_anti").select(F.lit("orphan").alias("issue_type"), F.lit("low").alias("severity"), F.col("id").cast("string").alias("subject"), F.lit(None).cast("string").alias("other"))
    of_item = weak_evidence(items, evidence).unionByName(missing_project(items)).unionByName(orphans)
    pages_ = items.select(F.col("id").cast("string").alias("subject"), F.when(F.col("project_key").isNotNull(), F.concat(F.lit("projects/"), F.col("project_key"), F.lit("/index"))).otherwise(F.concat(F.lit("types/"), F.col("memory_type"))).alias("page_key"))
    return of_item.join(pages_, "subject").unionByName(topic.withColumn("page_key", F.concat(F.lit("topics/"), slug("subject"))))


def duplicate_issues(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Issues for pairs (first_id, second_id) of memories that say the same, on their project's page, with both titles as samples."""
    one = items.select(F.col("id").cast("string").alias("_i"), "title", "project_key")
    held = pairs.select(F.col("first_id").cast("string").alias("subject"), F.col("second_id").cast("string").alias("other"))
    held = held.join(one.select(F.col("_i").alias("subject"), F.col("title").alias("_t1"), "project_key"), "subject").join(one.select(F.col("_i").alias("other"), F.col("title").alias("_t2")), "other")
    page = F.when(F.col("project_key").isNotNull(), F.concat(F.lit("projects/"), "project_key", F.lit("/index")))
    return held.select(F.lit("duplicate_concept").alias("issue_type"), F.lit("low").alias("severity"), "subject", "other", page.alias("page_key"), F.array("_t1", "_t2").alias("samples"))


def full_lint_report(items: DataFrame, evidence: Column | None = None, least: int = BROAD_ITEMS, short: int = BROAD_SUMMARY, positive: Sequence[str] = V.POSITIVE, negative: Sequence[str] = V.NEGATIVE, kept: DataFrame | None = None) -> DataFrame:
    """All issues: those of lint_report with their titles as samples, topics with conflicting guidance inside a project,
    memories that say the same, and (kept: a table of page_keys) pages that nothing asks for any more.

    A conflict is one issue for each topic and project (its members are conflict_groups). Memories that say the same are
    linked class by class: each copy with the first of its title and summary, and each pair of classes by their first.
    """
    titles = items.select(F.col("id").cast("string").alias("subject"), F.array("title").alias("samples"))
    plain = lint_report(items, evidence, least, short).join(titles, "subject", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    found = plain.unionByName(conflict_issues(items, positive, negative)).unionByName(duplicate_issues(duplicate_classes(items), items))
    if kept is not None:
        found = found.unionByName(orphan_pages(kept, items).withColumn("samples", F.array().cast("array<string>")))
    return found


def page_warnings(issues: DataFrame, most: int = 6) -> DataFrame:
    """(page_key, warning_no, issue_type, subject, other): the first issues of each project's page."""
    place = F.row_number().over(Window.partitionBy("page_key").orderBy("issue_type", "subject", "other"))
    rows = issues.filter(F.col("page_key").startswith("projects/")).withColumn("warning_no", place)
    return rows.filter(F.col("warning_no") <= most).select("page_key", "warning_no", "issue_type", "subject", "other")


def _taking_sides(items: DataFrame, positive: Sequence[str], negative: Sequence[str], *more: str) -> DataFrame:
    """(topic, project_key, word, polarity, id, more...) of memories that ask for or forbid something, a row for each topic and title word."""
    rows = items.withColumn("polarity", polarity(F.concat_ws(" ", "summary", "details"), positive, negative)).filter("polarity <> 0")
    return with_topics(rows).select("topic", "project_key", F.explode(token_set("title")).alias("word"), "polarity", "id", *more)


def conflict_members(items: DataFrame, positive: Sequence[str] = V.POSITIVE, negative: Sequence[str] = V.NEGATIVE, same: Sequence[str] = ()) -> DataFrame:
    """(id) of the memories that are in a conflict with one that has equal values in the columns `same`. No pair is made."""
    sides = _taking_sides(items, positive, negative, *same)
    key = ["topic", "project_key", "word", *same]
    both = sides.groupBy(*key).agg(F.min("polarity").alias("_min"), F.max("polarity").alias("_max")).filter("_min < _max").select(*(F.col(c).alias(f"_{c}") for c in key))
    match = F.lit(True)
    for c in key:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return sides.join(both, match, "left_semi").select("id").distinct()


def conflict_groups(items: DataFrame, positive: Sequence[str] = V.POSITIVE, negative: Sequence[str] = V.NEGATIVE) -> DataFrame:
    """(topic, project_key, word, asking, forbidding, polarity, part, members): conflicts of one topic, project and title
    word without their pairs. Every member of a group with polarity 1 conflicts with every one with -1.

    A group has the counts of its two sides, and its members are dealt by a hash of their id into parts of MEMBERS or
    so, so rows and their sizes grow with the memories' topics and words, not with the pairs.
    """
    words = _taking_sides(items, positive, negative)
    key = ["topic", "project_key", "word"]
    sides = words.groupBy(*key).agg(F.count_if(F.col("polarity") == 1).alias("asking"), F.count_if(F.col("polarity") == -1).alias("forbidding")).filter("asking > 0 and forbidding > 0")
    same = F.col("w.topic").eqNullSafe(F.col("s.topic")) & F.col("w.project_key").eqNullSafe(F.col("s.project_key")) & (F.col("w.word") == F.col("s.word"))
    held = words.alias("w").join(sides.alias("s"), same).select("w.*", "asking", "forbidding")
    parts = F.ceil(F.when(F.col("polarity") == 1, F.col("asking")).otherwise(F.col("forbidding")) / MEMBERS)
    held = held.withColumn("part", F.pmod(F.xxhash64("id"), parts.cast("long")).cast("int"))
    return held.groupBy(*key, "asking", "forbidding", "polarity", "part").agg(F.sort_array(F.collect_list("id")).alias("members"))


def conflicting_pairs(groups: DataFrame) -> DataFrame:
    """(topic, first_id, second_id): the pairs that conflict_groups stand for, each once; as many as conflict."""
    side = lambda p, n: groups.filter(F.col("polarity") == p).select("topic", F.coalesce("project_key", F.lit("\u0000")).alias("project"), "word", F.col("members").alias(n))
    pairs = side(1, "yes").join(side(-1, "no"), ["topic", "project", "word"]).select("topic", F.explode("yes").alias("yes"), "no").select("topic", "yes", F.explode("no").alias("no"))
    return pairs.select("topic", F.least("yes", "no").alias("first_id"), F.greatest("yes", "no").alias("second_id")).distinct()


def conflicts(items: DataFrame, positive: Sequence[str] = V.POSITIVE, negative: Sequence[str] = V.NEGATIVE) -> DataFrame:
    """(topic, first_id, second_id): memories of one topic and project whose titles share a word and of which one asks for
    what the other forbids. Pairs that agree are never made; for output that grows with the memories see conflict_groups.

    A pair is taken at the least word that its titles share, so pairs aren't shuffled to be told apart (only where an id has
    several rows). Those that ask are dealt into parts of MEMBERS or so; those that forbid go to each part of their group.
    """
    rows = items.withColumn("polarity", polarity(F.concat_ws(" ", "summary", "details"), positive, negative)).filter("polarity <> 0")
    rows = with_topics(rows.withColumn("_w", F.array_sort(token_set("title")))).withColumn("project", F.coalesce("project_key", F.lit("\u0000")))
    words = F.transform("_w", lambda w, i: F.struct(w.alias("word"), F.slice("_w", 1, i).alias("before")))
    sides = stored(rows.select("topic", "project", "polarity", "id", F.inline(words)), "sides")
    key = ["topic", "project", "word"]
    sizes = sides.groupBy(*key).agg(F.count_if(F.col("polarity") == 1).alias("asking"), F.count_if(F.col("polarity") == -1).alias("forbidding")).filter("asking > 0 and forbidding > 0")
    held = sides.join(sizes.select(*key, F.ceil(F.col("asking") / MEMBERS).cast("long").alias("parts")), key)
    yes = held.filter("polarity = 1").select(*key, F.pmod(F.xxhash64("id"), "parts").alias("part"), F.col("id").alias("yes"), F.col("before").alias("_yes"))
    no = held.filter("polarity = -1").select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("id").alias("no"), F.col("before").alias("_no"))
    pairs = yes.join(no, [*key, "part"]).filter(~F.arrays_overlap("_yes", "_no"))
    found = pairs.select("topic", F.least("yes", "no").alias("first_id"), F.greatest("yes", "no").alias("second_id"))
    several = sides.select("id", "topic", "project", "polarity", F.size("before").alias("_n")).filter("_n = 0").groupBy("id", "topic").agg(F.count("*").alias("_c")).filter("_c > 1")
    return found if several.isEmpty() else found.distinct()


def conflict_issues(items: DataFrame, positive: Sequence[str] = V.POSITIVE, negative: Sequence[str] = V.NEGATIVE) -> DataFrame:
    """Issues for the topics that have conflicting guidance inside a project: one for each, with the first title of either side as samples."""
    words = _taking_sides(items, positive, negative).join(items.select("id", "title"), "id")
    first = lambda p: F.min(F.when(F.col("polarity") == p, F.col("title")))
    found = words.groupBy("topic", "project_key", "word").agg(first(1).alias("yes"), first(-1).alias("no")).filter("yes is not null and no is not null")
    named = found.groupBy("topic", "project_key").agg(F.min("yes").alias("yes"), F.min("no").alias("no"))
    return named.select(
        F.lit("conflicting_topic").alias("issue_type"), F.lit("high").alias("severity"), F.col("topic").alias("subject"), F.col("project_key").alias("other"),
        F.concat(F.lit("topics/"), slug("topic")).alias("page_key"), F.array("yes", "no").alias("samples"),
    )


def near_titles(items: DataFrame, least: float = 0.8) -> DataFrame:
    """(first_id, second_id, jaccard): memories of one project and type whose titles share so much of their words.

    Titles that share `least` of their words share a word among the rarest few of each, so pairs are made by these words
    only: of a title with n words the n - ceil(least * n) + 1 rarest, frequency counted over all titles.
    """
    rows = items.select("id", F.concat_ws("\u0001", F.coalesce("project_key", F.lit("\u0000")), "memory_type").alias("part"), token_set("title").alias("words")).filter(F.size("words") > 0)
    # equal word sets are one node; its members are linked through its smallest id
    nodes = rows.withColumn("words", F.array_sort("words")).groupBy("part", "words").agg(F.min("id").alias("id"))
    members = rows.withColumn("words", F.array_sort("words")).join(nodes.withColumnRenamed("id", "rep"), ["part", "words"]).filter("id <> rep").select(F.col("rep").alias("first_id"), F.col("id").alias("second_id"), F.lit(1.0).alias("jaccard"))
    single = nodes.select("id", "part", "words", F.explode("words").alias("word"))
    counts = single.groupBy("part", "word").agg(F.count("*").alias("freq"))
    ranked = single.join(counts, ["part", "word"]).withColumn("_place", F.row_number().over(Window.partitionBy("id").orderBy("freq", "word")))
    n = F.size("words")
    keyed = ranked.filter(F.col("_place") <= n - F.ceil(n * least - 1e-9) + 1).select("part", "word", "id", "words")
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.id") < F.col("b.id")) & (F.size("a.words") >= F.size("b.words") * least) & (F.size("b.words") >= F.size("a.words") * least))
    common = F.size(F.array_intersect("a.words", "b.words"))
    jaccard = common / (F.size("a.words") + F.size("b.words") - common)
    found = pairs.select(F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"), jaccard.alias("jaccard")).filter(F.col("jaccard") >= least - 1e-12).distinct()
    return found.unionByName(members)


def _like_titles(titles: DataFrame, least: float) -> DataFrame:
    """(a, b, ab, ba): pairs of titles of one part whose ratio, in one order or the other, is `least` or more; titles: (part, tid, t).

    Every pair of a part is looked at, in tiles of two blocks of TILE titles. No pair is left out unless its lengths,
    its letters or (up to 64 letters) its longest common subsequence rule it out.
    """
    blocks = titles.groupBy("part").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    placed = titles.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("part", "tid", "t", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def run(tile: pa.Table) -> pa.Table:
        tid, block = tile.column("tid").to_numpy(), tile.column("block").to_numpy()
        low, high = tile.column("low")[0].as_py(), tile.column("high")[0].as_py()
        texts = [t.lower() for t in tile.column("t").to_pylist()]
        sizes, counts = np.array([len(t) for t in texts], np.int64), letter_counts(texts)
        # a title of 64 letters has no like one of more letters than this
        width = min(int(sizes.max(initial=1)), int(64 * (2 - least) / least) + 1)
        codes = np.zeros((len(texts), width), np.int64)
        for i, t in enumerate(texts):
            own = np.frombuffer(t[:width].encode("utf-32-le", "surrogatepass"), np.uint32)
            codes[i, : len(own)] = own
        found: list[tuple[int, int, float, float]] = []
        for i in np.flatnonzero(block == low).tolist():
            others = np.flatnonzero((block == high) & ((tid > tid[i]) | (low != high)))
            need = (sizes[i] + sizes[others]) * least / 2 - 1e-9
            near = np.minimum(sizes[i], sizes[others]) >= need
            others, need = others[near], need[near]
            near = common_letters(counts[i], counts[others]) >= need
            others, need = others[near], need[near]
            if sizes[i] <= 64 and len(others):
                others = others[common_subsequence(texts[i], codes[others]) >= need]
            for j in others.tolist():
                ab, ba = SequenceMatcher(None, texts[i], texts[j]).ratio(), SequenceMatcher(None, texts[j], texts[i]).ratio()
                if max(ab, ba) >= least:
                    found.append((int(tid[i]), int(tid[j]), ab, ba))
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["a", "b", "ab", "ba"])

    return dealt(tiles, "part", "low", "high").groupBy("part", "low", "high").applyInArrow(run, "a long, b long, ab double, ba double")


def duplicate_classes(items: DataFrame, title: float = 0.83, both: float = 0.72) -> DataFrame:
    """(first_id, second_id): as duplicate_concepts, but between the first memories of equal titles and summaries, and of each
    copy with its first; no link between different texts is lost, and copies don't make pairs among themselves."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = items.select("id", "title", "summary", "project_key", "memory_type", text("title").alias("_t"), text("summary").alias("_s"), F.coalesce("project_key", F.lit("\u0000")).alias("_p"))
    first = rows.groupBy("_p", "memory_type", "_t", "_s").agg(F.min("id").alias("_first"))
    copies = rows.join(first, ["_p", "memory_type", "_t", "_s"])
    pairs = duplicate_concepts(copies.filter("id = _first").select("id", "title", "summary", "project_key", "memory_type"), title, both).select("first_id", "second_id")
    return pairs.unionByName(copies.filter("id <> _first").select(F.col("_first").alias("first_id"), F.col("id").alias("second_id")))


def duplicate_concepts(items: DataFrame, title: float = 0.83, both: float = 0.72) -> DataFrame:
    """(first_id, second_id, title_ratio, summary_ratio): memories of one project and type with like titles, or like titles and summaries, by the matching-blocks ratio.

    All such pairs, those of copies too, so their number is quadratic in what is alike. Ratios are worked out once for
    equal titles and once for equal titles and summaries; null counts as empty.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = items.select("id", F.concat_ws("\u0001", F.coalesce("project_key", F.lit("\u0000")), "memory_type").alias("part"), text("title").alias("t"), text("summary").alias("s"))
    classes = rows.groupBy("part", "t", "s").agg(F.min("id").alias("cid"), F.max("id").alias("last"))
    # titles are numbered, whatever ids are; written, so that the numbers stay
    titles = stored(classes.select("part", "t").distinct().withColumn("tid", F.monotonically_increasing_id()), "titles")
    classes = classes.join(titles, ["part", "t"]).select("part", "t", "s", "cid", "last", "tid")
    # written: what follows reads them more than once
    like = stored(_like_titles(titles, both), "like").unionByName(titles.select(F.col("tid").alias("a"), F.col("tid").alias("b"), F.lit(1.0).alias("ab"), F.lit(1.0).alias("ba")))
    side = lambda n: classes.select(F.col("tid").alias(n), F.col("cid").alias(f"{n}_cid"), F.col("last").alias(f"{n}_last"), F.col("s").alias(f"{n}_s"))
    pairs = like.join(side("a"), "a").join(side("b"), "b").filter((F.col("a") != F.col("b")) | (F.col("a_cid") <= F.col("b_cid")))
    same = F.col("a_s") == F.col("b_s")
    # summaries are compared in the order of ids alone: in both only if members of either class come first
    rates = lambda n, m: F.when(F.col(f"{n}_cid") < F.col(f"{m}_last"), ratio(*(F.when(F.col(f"{n}_cid") < F.col(f"{m}_last"), F.col(f"{x}_s")) for x in (n, m))))
    rated = dealt(pairs.filter(~same), "a_cid", "b_cid").withColumn("s_ab", rates("a", "b")).withColumn("s_ba", rates("b", "a")).unionByName(pairs.filter(same).withColumn("s_ab", F.lit(1.0)).withColumn("s_ba", F.lit(1.0)))
    ok = lambda t, s: (F.col(t) >= title) | ((F.col(t) >= both) & (F.col(s) >= both))
    rated = rated.filter(F.coalesce(ok("ab", "s_ab"), F.lit(False)) | F.coalesce(ok("ba", "s_ba"), F.lit(False))).select("a_cid", "b_cid", "ab", "ba", "s_ab", "s_ba")
    members = rows.join(classes.select("part", "t", "s", "cid"), ["part", "t", "s"])
    member = lambda n: members.select(F.col("cid").alias(f"{n}_cid"), F.col("id").alias(f"{n}_id"))
    found = rated.join(member("a"), "a_cid").join(member("b"), "b_cid").filter((F.col("a_cid") != F.col("b_cid")) | (F.col("a_id") < F.col("b_id")))
    ahead = F.col("a_id") < F.col("b_id")
    found = found.select(F.least("a_id", "b_id").alias("first_id"), F.greatest("a_id", "b_id").alias("second_id"), F.when(ahead, F.col("ab")).otherwise(F.col("ba")).alias("title_ratio"), F.when(ahead, F.col("s_ab")).otherwise(F.col("s_ba")).alias("summary_ratio"))
    return found.filter(ok("title_ratio", "summary_ratio"))
