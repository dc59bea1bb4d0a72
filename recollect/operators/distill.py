"""From raw events to memories: snippets, candidates, their merging, and the reconciling with what is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.text import excerpt, has_any, has_any_lower, is_garbled, is_low_value, is_sensitive, sensitivity, squash, stable_id
from ..sources.model import stored

#: Thresholds of activation without review.
AUTO_CONFIDENCE, AUTO_STABILITY = 0.78, 0.65
#: Snippets of an event, pieces of evidence of a memory, characters of merged details.
SNIPPETS, EVIDENCE, DETAILS = 8, 12, 1600


def _preference(text: Column) -> Column:
    """Whether one of the preference patterns begins the text."""
    found = F.lit(False)
    for words, _ in V.PREFERENCES:
        found = found | text.rlike(f"(?i)^(?:{'|'.join(words)})\\s*.+$")
    return found


def snippets(events: DataFrame, keywords: Sequence[str] = V.EXPLICIT_KEYWORDS, projects: Sequence[str] = V.PROJECT_HINTS) -> DataFrame:
    """Events of users, a row for each of their first SNIPPETS sentences that may teach something: snippet_no and snippet.

    White space is collapsed before the text is cut, so line ends don't cut it; a sentence counts from 6 characters, if
    it isn't of low value, and holds an activating word, begins as a preference, or (up to 160 characters) hints at a project.
    """
    flat = squash("text")
    rows = events.filter((F.col("role") == "user") & (F.length(F.trim("text")) >= 6)).withColumn("_flat", flat).filter((F.col("_flat") != "") & ~is_garbled("_flat"))
    parts = F.transform(F.split("_flat", V.SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, V.BULLET, "")))
    wanted = lambda s: (F.length(s) >= 6) & (has_any_lower(s, keywords) | _preference(s) | (has_any_lower(s, projects) & (F.length(s) <= 160))) & ~is_low_value(s, keywords)
    kept = F.slice(F.filter(parts, wanted), 1, SNIPPETS)
    return rows.select("*", F.posexplode(kept).alias("snippet_no", "snippet")).drop("_flat")


def _body(text: Column) -> Column:
    """What a preference is about: stripped of punctuation and of a polite prefix, 96 characters at most."""
    plain = F.regexp_replace(squash(text), "^[ ，。；;:：!?！？]+|[ ，。；;:：!?！？]+$", "")
    return excerpt(F.regexp_replace(plain, r"^(请你|请)\s*", ""), 96)


def compacted(snippet: Column) -> Column:
    """A snippet without its bullet, 320 characters at most."""
    return excerpt(F.regexp_replace(snippet, V.BULLET, ""), 320)


def summarize(compact: Column, keywords: Sequence[str] = V.EXPLICIT_KEYWORDS, projects: Sequence[str] = V.PROJECT_HINTS) -> Column:
    """struct(title, hint) of a compacted snippet, null where there is nothing to keep: the first preference pattern that begins
    it, else a rule by an activating word, a warning, or a fact about a project."""
    none = F.lit(None).cast("struct<title:string,hint:string>")
    made = lambda title, hint: F.struct(excerpt(title, 72).alias("title"), F.lit(hint).alias("hint"))
    out = F.when(has_any_lower(compact, keywords), made(compact, "rule")).when(has_any(compact, V.CAUTIONS), made(compact, "watchout")).when(has_any_lower(compact, projects) & (F.length(compact) <= 160), made(compact, "fact")).otherwise(none)
    for words, hint in reversed(V.PREFERENCES):
        pattern = f"(?i)^({'|'.join(words)})\\s*(.+)$"
        action, body = F.regexp_extract(compact, pattern, 1), _body(F.regexp_extract(compact, pattern, 2))
        out = F.when(compact.rlike(pattern), F.when(body != "", made(F.concat_ws(" ", action, body), hint))).otherwise(out)
    return F.when(~is_low_value(compact, keywords), out)


def memory_type(title: Column, hint: Column) -> Column:
    return F.when((hint == "preference") | has_any_lower(title, V.LANGUAGE_HINTS), "profile").when(hint.isin("rule", "procedure", "watchout") | has_any_lower(title, V.PROCEDURE_HINTS), "procedural").otherwise("semantic")


def tool_scope(text: Column, tools: Sequence[tuple[str, str]]) -> Column:
    """The one tool that the text names by id or label, else shared."""
    named = F.array_compact(F.array(*(F.when(has_any_lower(text, [x for x in names if x]), names[0]) for names in tools))) if tools else F.array().cast("array<string>")
    return F.when(F.size(named) == 1, F.try_element_at(named, F.lit(1))).otherwise("shared")


def candidates(found: DataFrame, keywords: Sequence[str] = V.EXPLICIT_KEYWORDS, tools: Sequence[tuple[str, str]] = (), sensitive: Sequence[str] = V.SENSITIVE, projects: Sequence[str] = V.PROJECT_HINTS) -> DataFrame:
    """A candidate memory for each snippet that has a summary, with its key."""
    rows = found.withColumn("_compact", compacted(F.col("snippet"))).withColumn("_s", summarize(F.col("_compact"), keywords, projects)).filter("_s is not null").withColumn("title", F.col("_s.title")).withColumn("hint", F.col("_s.hint"))
    rows = rows.withColumn("scope", F.when(F.col("project_key").isNotNull() & has_any_lower("title", projects), "project").otherwise("global"))
    rows = rows.withColumn("memory_type", memory_type(F.col("title"), F.col("hint"))).withColumn("tool", F.when(F.col("scope") == "project", "shared").otherwise(tool_scope(F.col("snippet"), tools)))
    review = (F.col("memory_type") == "profile") | (F.col("scope") == "project")
    tags = F.array_compact(F.array("hint", "memory_type", "source_tool", F.when(F.col("scope") == "project", F.col("project_key")), F.when(review, "needs-review")))
    hidden = F.when(is_sensitive("snippet", sensitive), "[redacted-sensitive]")
    return rows.select(
        stable_id("memory_type", "scope", "tool", F.coalesce("project_key", F.lit("")), F.lower("title")).alias("key"),
        "title", "hint", "memory_type", "scope", "tool", "project_key",
        F.coalesce(hidden, F.col("snippet")).alias("details"),
        F.array_distinct(tags).alias("tags"),
        F.struct("source_tool", "source_path", "session_id", "timestamp", F.coalesce(hidden, excerpt("snippet", 220)).alias("excerpt")).alias("evidence"),
        (F.lit(55) + F.when(F.col("hint").isin("rule", "procedure"), 18).otherwise(10)).alias("confidence_pct"),
        F.when(F.col("hint").isin("rule", "watchout", "fact"), 80).otherwise(65).alias("stability_pct"),
        sensitivity("snippet", sensitive).alias("sensitivity"),
        "timestamp",
        F.struct(F.coalesce("timestamp", F.lit("")), "source_path", "id", "snippet_no").alias("ord"),
    )


def merge(found: DataFrame) -> DataFrame:
    """One memory for each key: evidence (the last EVIDENCE pieces in order), tags united, surest values, and the number of repetitions.

    Each repetition adds 0.08 of confidence and 0.07 of stability, up to 0.99; what reaches both thresholds, is neither
    a project's nor a profile and needs no review becomes active. Percentages are whole numbers, so sums are exact.
    Only the ends of long lists are kept: each key's rows are first cut to those that its evidence and details can hold.
    """
    found = stored(found, "candidates")
    details = lambda rows: F.array_join(F.transform(rows, lambda r: r["details"]), "\n\n")
    base = found.groupBy("key").agg(
        F.count("*").alias("repetitions"),
        F.min_by(F.struct("title", "memory_type", "scope", "tool", "project_key", "details"), "ord").alias("first"),
        F.max_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("ord"))).alias("last_seen_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.max("confidence_pct").alias("c"),
        F.max("stability_pct").alias("s"),
        F.bool_or(F.col("sensitivity") == "high").alias("high"),
    )
    # a memory's details end at DETAILS characters and its evidence at EVIDENCE pieces: so many first and last rows can
    # count. Each list has a limit on its rank alone, which is applied before the shuffle: a sentence that all say sends
    # so many rows a task, however often it is said
    def ends(order: Column, most: int, column: str, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("key").orderBy(order))
        few = found.select("key", "ord", column).withColumn("_n", rank).filter(F.col("_n") <= most)
        return few.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", column))).alias(name))

    lists = ends(F.col("ord").asc(), DETAILS // 8, "details", "texts").join(ends(F.col("ord").desc(), EVIDENCE, "evidence", "pieces"), "key")
    rows = base.join(lists, "key")
    confidence = F.least(F.lit(99), F.col("c") + (F.col("repetitions") - 1) * 8)
    stability = F.least(F.lit(99), F.col("s") + (F.col("repetitions") - 1) * 7)
    rows = rows.withColumn("cp", confidence).withColumn("sp", stability)
    ready = (F.col("cp") >= int(AUTO_CONFIDENCE * 100)) & (F.col("sp") >= int(AUTO_STABILITY * 100)) & (F.col("first.scope") != "project") & (F.col("first.memory_type") != "profile") & ~F.array_contains("tags", "needs-review")
    return rows.select(
        F.col("key").alias("id"),
        "first.title", "first.memory_type", "first.scope", "first.tool", "first.project_key",
        F.col("first.title").alias("summary"),
        F.when(F.col("repetitions") == 1, F.col("first.details")).otherwise(excerpt(details(F.col("texts")), DETAILS)).alias("details"),
        F.transform("pieces", lambda p: p["evidence"]).alias("evidence"),
        (F.col("cp") / 100.0).alias("confidence"),
        (F.col("sp") / 100.0).alias("stability"),
        F.when(F.col("high"), "high").otherwise("low").alias("sensitivity"),
        "tags", "last_seen_at", "repetitions",
        F.when(ready, "active").otherwise("candidate").alias("status"),
    )


def consolidate(events: DataFrame, keywords: Sequence[str] = V.EXPLICIT_KEYWORDS, tools: Sequence[tuple[str, str]] = (), sensitive: Sequence[str] = V.SENSITIVE, projects: Sequence[str] = V.PROJECT_HINTS) -> DataFrame:
    """Events to memories, by rules alone."""
    return merge(candidates(snippets(events, keywords, projects), keywords, tools, sensitive, projects))


def reconcile(new: DataFrame, known: DataFrame) -> DataFrame:
    """New memories over known ones with the same id: when they were made, reviewed and by whom stays; what was
    overridden by hand keeps its text and judgement and only gains evidence, tags and the time last seen."""
    k = known.select(F.struct("*").alias("k"), F.col("id"))
    rows = new.join(k, "id", "left")
    held = F.coalesce(F.col("k.manual_override"), F.lit(False))
    keep = lambda c: F.when(held, F.col(f"k.{c}")).otherwise(F.col(c)).alias(c)
    evidence = F.concat(F.coalesce("k.evidence", F.array().cast(new.schema["evidence"].dataType)), "evidence")
    return rows.select(
        "id",
        *(keep(c) for c in ("title", "memory_type", "scope", "tool", "project_key", "summary", "details", "confidence", "stability", "status")),
        F.when(held, F.slice(evidence, F.greatest(F.size(evidence) - EVIDENCE + 1, F.lit(1)), EVIDENCE)).otherwise(F.col("evidence")).alias("evidence"),
        F.when(held, F.array_sort(F.array_union("k.tags", "tags"))).otherwise(F.col("tags")).alias("tags"),
        F.coalesce("last_seen_at", F.when(held, F.col("k.last_seen_at"))).alias("last_seen_at"),
        F.coalesce("k.created_at", "last_seen_at").alias("created_at"),
        F.col("k.reviewed_at").alias("reviewed_at"),
        F.coalesce("k.managed_by", F.lit("system")).alias("managed_by"),
        held.alias("manual_override"),
        F.coalesce("k.expiration_days", F.lit(90)).alias("expiration_days"),
    )


def matched_evidence(found: DataFrame, events: DataFrame, batch: str, most: int = 3) -> DataFrame:
    """(id, place, event_id): for each candidate (id, batch, title, summary) the first events (id, batch, ord, text) of its
    batch whose text stands in the summary or holds the title; batches, which one call distils, are of bounded size."""
    e = events.select(batch, F.col("id").alias("event_id"), "ord", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    pairs = found.select("id", batch, F.lower("title").alias("title"), F.lower("summary").alias("summary")).join(e, batch)
    rows = pairs.filter(F.contains("summary", "t") | F.contains("t", "title"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).filter(F.col("place") <= most).select("id", "place", "event_id")


def write_memory(memory: DataFrame) -> DataFrame:
    """Memories written by hand, with the id that their fields give, overriding what is distilled."""
    return memory.withColumn("id", stable_id("memory_type", "scope", "tool", F.coalesce("project_key", F.lit("")), F.lower("title"), "summary")).withColumn("manual_override", F.lit(True)).withColumn("managed_by", F.lit("user"))
