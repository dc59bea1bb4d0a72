"""Session digests and the skills that come out of them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.similarity import Matchable, common_letters, letter_counts
from ..functions.text import all_matches, code_blocks, excerpt, first_match, has_any_lower, sentences_with, stable_id, token_set
from ..sources.model import stored
from .ranks import dealt, numbered

#: Messages of a chunk, and sessions shorter than this stay whole under their own id.
CHUNK, WHOLE = 20, 4
#: Texts of digests and of memories that are compared in one task.
TILE = (2048, 512)


def chunks(events: DataFrame, order: Sequence[str] = ("timestamp", "line_no")) -> DataFrame:
    """Messages with text, with their session (`unknown` if null), chunk_no, chunk_id, and message_no within the chunk.

    Messages are numbered within their session by ranges of session and order, so a session of any length (all messages
    without one are one session) is spread over tasks. Equal places are told apart by the id, if there is one.
    """
    rows = events.filter(F.coalesce("text", F.lit("")) != "").withColumn("session", F.coalesce("session_id", F.lit("unknown")))
    by = [*order, *(c for c in ("id",) if c in events.columns)]
    rows = numbered(rows, ["session"], by, "_n").withColumn("_n", F.col("_n") - 1)
    short = rows.groupBy("session").agg(F.count("*").alias("_all")).filter(F.col("_all") < WHOLE).select("session", F.lit(True).alias("_short"))
    rows = rows.join(short, "session", "left")
    rows = rows.withColumn("chunk_no", F.floor(F.col("_n") / CHUNK).cast("int")).withColumn("message_no", (F.col("_n") % CHUNK).cast("int"))
    whole = F.coalesce("_short", F.lit(False))
    return rows.withColumn("chunk_id", F.when(whole, F.col("session")).otherwise(F.concat("session", F.lit("-chunk-"), F.col("chunk_no").cast("string")))).drop("_n", "_short")


def decisions(text: Column, words: Sequence[str] = V.DECISIONS) -> Column:
    """Sentences with the first decision word that the text holds, over 10 characters, as excerpts of 150."""
    out = F.array().cast("array<string>")
    for w in reversed(words):
        out = F.when(has_any_lower(text, [w]), sentences_with(text, F.lit(w.lower()), V.DECISION_END, 10, 150)).otherwise(out)
    return out


def every_decision(text: Column, words: Sequence[str] = V.DECISIONS) -> Column:
    """Sentences with any decision word, word by word, over 10 characters, the first 200 of each; the first of equal ones stays."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), V.DECISION_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.array_distinct(F.flatten(F.array(*(F.transform(_holding(parts, w), lambda s: F.substring(s, 1, 200)) for w in words))))


def _holding(parts: Column, word: str) -> Column:
    return F.filter(parts, lambda s: F.contains(F.lower(s), F.lit(word.lower())) & (F.length(s) > 10))


def insights(text: Column, messages: Sequence[str] = V.INSIGHT_MESSAGES, sentences: Sequence[str] = V.INSIGHT_SENTENCES) -> Column:
    """Of texts with an insight word the sentences over 15 characters that hold a marker as written, as excerpts of 200."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), V.INSIGHT_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))

    def marked(s: Column) -> Column:
        found = F.lit(False)
        for m in sentences:
            found = found | F.contains(s, F.lit(m))
        return found & (F.length(s) > 15)

    return F.when(has_any_lower(text, messages), F.transform(F.filter(parts, marked), lambda s: excerpt(s, 200))).otherwise(F.array().cast("array<string>"))


def follow_ups(text: Column, words: Sequence[str] = V.FOLLOW_UPS) -> Column:
    """What is said to come later: a follow-up word and 10 to 100 characters of the sentence after it."""
    pattern = rf"(?i)((?:{'|'.join(words)})[:\s]*[^.!?\n]{{10,100}})"
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1), lambda s: excerpt(s, 150))


def digests(events: DataFrame, decision_words: Sequence[str] = V.DECISIONS, insight_words: tuple[Sequence[str], Sequence[str]] = (V.INSIGHT_MESSAGES, V.INSIGHT_SENTENCES), categories=V.CATEGORIES, follow_words: Sequence[str] = V.FOLLOW_UPS) -> DataFrame:
    """One digest for each chunk of a session: title, category, key decisions, insights, follow-ups, fragments, counts.

    Everything is drawn from each message first, and chunks, which hold CHUNK messages at most, are put together after.
    The title is the first user message of over 10 characters, else the last short one before, else the first message.
    """
    rows = chunks(events).select(
        "chunk_id", "session", "source_tool", "project_key", "message_no", "timestamp", "role", "text",
        decisions(F.col("text"), decision_words).alias("d"),
        insights(F.col("text"), *insight_words).alias("i"),
        follow_ups(F.col("text"), follow_words).alias("f"),
        code_blocks("text").alias("code"),
        F.when(F.col("role").isin("user", "human"), F.when(F.length("text") > 10, F.col("message_no")).otherwise(2 * CHUNK - F.col("message_no"))).otherwise(2 * CHUNK + 1 + F.col("message_no")).alias("claim"),
    )
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("message_no", c))), lambda x: x[c]))
    made = rows.groupBy("chunk_id", "session").agg(
        F.count("*").alias("message_count"),
        F.first("source_tool").alias("source_tool"),
        F.min("project_key").alias("related_project"),
        F.min("timestamp").alias("created_at"),
        F.min_by("text", "claim").alias("first_text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_no", "text"))), lambda x: x["text"]), " ").alias("all_text"),
        F.slice(F.array_distinct(ordered("d")), 1, 5).alias("key_decisions"),
        ordered("i").alias("i"),
        F.slice(F.array_distinct(ordered("f")), 1, 3).alias("follow_ups"),
        F.slice(ordered("code"), 1, 5).alias("code"),
    )
    # of insights that differ by case only the first stays
    firsts = F.filter(F.transform("i", lambda x, n: F.when(F.array_position(F.transform("i", F.lower), F.lower(x)) == n + 1, x)), lambda x: x.isNotNull())
    category = first_match("all_text", categories, "exploration")
    title = excerpt("first_text", 60)
    return made.select(
        stable_id(F.lit("digest"), "chunk_id").alias("id"),
        "chunk_id", "session", "source_tool", "related_project", "created_at", "message_count",
        F.when(title == "", F.concat(F.lit("关于 "), category, F.lit(" 的讨论"))).otherwise(title).alias("title"),
        category.alias("category"),
        "key_decisions",
        F.slice(firsts, 1, 5).alias("insights"),
        "follow_ups",
        F.transform("code", lambda c: F.concat(F.lit("代码片段 ("), c["lang"], F.lit(")"))).alias("fragments"),
        "code",
        excerpt("all_text", 180).alias("summary"),
        F.array_distinct(F.concat(F.array(category), all_matches("all_text", V.SUGGESTED_TAGS))).alias("tags"),
        F.lit("active").alias("status"),
    )


def new_digests(made: DataFrame, known: DataFrame) -> DataFrame:
    """Digests that aren't known yet; ids are those of their chunks, so a second run adds nothing."""
    return made.join(known.select("id"), "id", "left_anti")


def like_texts(digests_: DataFrame, memories: DataFrame, least: float = 0.3) -> DataFrame:
    """(digest_id, memory_id, score): all pairs whose text ratio is `least` or more; digests_: (digest_id, dt), memories: (memory_id, mt).

    Texts are classed by their length so that a pair above the bound lies in neighbouring classes; within these every
    pair of different texts is looked at, in tiles, and left out only where its lengths, its letters or what can match
    from rare letters rule it out. Work is quadratic in the texts of a class.
    """
    texts = lambda df, c: df.select(F.col(c).alias("text")).distinct().withColumn("level", F.floor(F.log(F.greatest(F.length("text"), F.lit(1))) / math.log((2 - least) / least + 0.05)).cast("int"))
    d, m = texts(digests_, "dt"), texts(memories, "mt")
    deal = lambda df, n, c: df.withColumn(c, F.pmod(F.xxhash64("text"), F.lit(n)).cast("int"))
    n_d, all_m = -(-d.count() // TILE[0]) or 1, m.count()
    # small tables are dealt to all cores
    n_m = max(1, -(-all_m // TILE[1]), min(all_m // 16, 4 * d.sparkSession.sparkContext.defaultParallelism))
    every = lambda n: F.explode(F.array(*map(F.lit, range(n)))) if n < 1000 else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = deal(d, n_d, "i").withColumn("j", every(n_m)).withColumn("level", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)))
    right = deal(m, n_m, "j").withColumn("i", every(n_d))

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        a, b = ours.column("text").to_pylist(), theirs.column("text").to_pylist()
        found: list[tuple[str, str, float]] = []
        if a and b:
            x, y = [t.lower() for t in a], [t.lower() for t in b]
            sizes, counts, matcher, matchable = np.array([len(t) for t in x]), letter_counts(x).astype(np.int32), SequenceMatcher(None), Matchable(x)
            for k, text in enumerate(y):
                need = (sizes + len(text)) * least / 2 - 1e-9
                near = np.flatnonzero(np.minimum(sizes, len(text)) >= need)
                if not len(near):
                    continue
                near = near[common_letters(letter_counts([text])[0].astype(np.int32), counts[near]) >= need[near]]
                if not len(near):
                    continue
                matcher.set_seq2(text)
                if len(text) >= 200:
                    near = near[matchable.within(text, matcher.b2j)[near] >= need[near]]
                for i in near.tolist():
                    matcher.set_seq1(x[i])
                    if (r := matcher.ratio()) >= least:
                        found.append((a[i], b[k], r))
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["dt", "mt", "score"])

    tile = ("level", "i", "j")
    pairs = dealt(left, *tile).groupBy(*tile).cogroup(dealt(right, *tile).groupBy(*tile)).applyInArrow(run, "dt string, mt string, score double")
    return pairs.join(digests_.select("digest_id", "dt"), "dt").join(memories.select("memory_id", "mt"), "mt").select("digest_id", "memory_id", "score")


def project_links(digests_: DataFrame, memories: DataFrame, size: int = 1000) -> DataFrame:
    """(project, digests, memories, side, part, members): the edges of one project without their pairs. Every digest of a
    project is linked with every memory of it; a project has the counts of both, and the ids of each side are dealt by a
    hash into parts of `size` or so, so rows grow with digests and memories, not with the pairs."""
    side = lambda df, project, name: df.filter(F.coalesce(project, F.lit("")) != "").select(F.col(project).alias("project"), F.col("id").cast("string").alias("id"), F.lit(name).alias("side"))
    rows = side(digests_, "related_project", "digest").unionByName(side(memories, "project_key", "memory"))
    counts = rows.groupBy("project").agg(F.count_if(F.col("side") == "digest").alias("digests"), F.count_if(F.col("side") == "memory").alias("memories")).filter("digests > 0 and memories > 0")
    held = rows.join(counts, "project")
    parts = F.ceil(F.when(F.col("side") == "digest", F.col("digests")).otherwise(F.col("memories")) / size)
    held = held.withColumn("part", F.pmod(F.xxhash64("id"), parts.cast("long")).cast("int"))
    return held.groupBy("project", "digests", "memories", "side", "part").agg(F.sort_array(F.collect_list("id")).alias("members"))


def _sharing_words(d: DataFrame, m: DataFrame) -> DataFrame:
    """(digest_id, memory_id): pairs that share two words or more; d: (digest_id, dw), m: (memory_id, mw), lists of distinct words.

    Titles meet by every two of their words, and a pair is taken at the two least words that it shares. So no pair of one shared
    word is made, and none twice: work grows with the pairs that are found. Words of an id with several rows count together;
    these few ids meet by single words.
    """
    sides = []
    for df, key, words in ((d, "digest_id", "dw"), (m, "memory_id", "mw")):
        rows = stored(df.select(key, F.array_sort(words).alias("ws")).filter(F.size("ws") > 0), "words")
        again = stored(rows.groupBy(key).agg(F.count("*").alias("_c")).filter("_c > 1").select(key), "again")
        # (first, second) of a list and the words before the second but for the first
        twos = F.flatten(F.transform("ws", lambda v, j: F.transform(F.slice("ws", 1, j), lambda w: F.struct(w.alias("w"), v.alias("v"), F.array_remove(F.slice("ws", 1, j), w).alias(f"{words}_before")))))
        by_two = rows.join(again, key, "left_anti").select(key, F.inline(twos))
        sides.append((key, rows, again, by_two))
    (dk, d, d_again, d_two), (mk, m, m_again, m_two) = sides
    found = d_two.join(m_two, ["w", "v"]).filter(~F.arrays_overlap("dw_before", "mw_before")).select(dk, mk)
    if d_again.isEmpty() and m_again.isEmpty():
        return found
    single = lambda rows: rows.select(rows.columns[0], F.explode("ws").alias("w"))
    odd = [single(d.join(d_again, dk, "left_semi")).join(single(m), "w"), single(d.join(d_again, dk, "left_anti")).join(single(m.join(m_again, mk, "left_semi")), "w")]
    counted = [x.groupBy(dk, mk).agg(F.count("*").alias("shared")).filter("shared >= 2").select(dk, mk) for x in odd]
    return found.unionByName(counted[0]).unionByName(counted[1])


def edges(digests_: DataFrame, memories: DataFrame, with_ratio: bool = False, by_project: bool = True) -> DataFrame:
    """(digest_id, memory_id, score, connection_type): the greatest of 0.4 for two shared title words, 0.5 for the same
    project, and (with_ratio) the text ratio where it is 0.3 or more; edges from 0.3, `extends` from 0.6.

    Without the ratio, pairs come from equal title words and equal projects alone; with it, like_texts looks at all.
    Pairs of one project are as many as its digests times its memories: by_project=False leaves them to project_links.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: w != ""))
    d = digests_.select(F.col("id").alias("digest_id"), words("title").alias("dw"), F.col("related_project").alias("dp"), F.lower(F.concat_ws(" ", "title", F.array_join("insights", " "), F.array_join("fragments", " "))).alias("dt"))
    m = memories.select(F.col("id").cast("string").alias("memory_id"), words("title").alias("mw"), F.col("project_key").alias("mp"), F.lower(F.concat_ws(" ", "title", "summary", "details", F.array_join("tags", " "))).alias("mt"))
    pairs = found = _sharing_words(d.select("digest_id", "dw"), m.select("memory_id", "mw")).withColumn("score", F.lit(0.4))
    if by_project:
        found = found.unionByName(d.join(m, (d.dp == m.mp) & (d.dp != "")).select("digest_id", "memory_id", F.lit(0.5).alias("score")))
    if with_ratio:
        found = found.unionByName(like_texts(d.select("digest_id", "dt"), m.select("memory_id", "mt")))
    if by_project or with_ratio:  # by words each pair is there once
        pairs = found.groupBy("digest_id", "memory_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("connection_type", F.when(F.col("score") >= 0.6, "extends").otherwise("relates_to"))


def skills_from_sessions(events: DataFrame, decision_words: Sequence[str] = V.DECISIONS, requests: Sequence[str] = V.SKILL_REQUESTS, least: int = 4, steps: int = 10) -> DataFrame:
    """A skill for each session of `least` messages or more that took a decision: its name (the first user message), up
    to `steps` steps, category, required tools, tags, and whether it was asked for."""
    rows = events.filter(F.coalesce("text", F.lit("")) != "").withColumn("session", F.coalesce("session_id", F.lit("unknown")))
    rows = rows.select("session", "line_no", "role", "text", every_decision(F.col("text"), decision_words).alias("d"), has_any_lower("text", requests).alias("asked"))
    user = F.when((F.col("role") == "user") & (F.length("text") > 5), F.col("line_no"))
    # what a session's text holds is gathered as flags, message by message; only decisions are gathered as text
    flags = {f"c_{n}": has_any_lower("text", w) for n, w in V.TASK_CATEGORIES} | {f"t_{n}": has_any_lower("text", w) for n, w in V.REQUIRED_TOOLS} | {f"g_{n}": has_any_lower("text", w) for n, w in V.SUGGESTED_TAGS}
    made = rows.groupBy("session").agg(
        F.count("*").alias("event_count"),
        F.min_by("text", user).alias("first_text"),
        F.bool_or("asked").alias("requested"),
        *(F.bool_or(c).alias(n) for n, c in flags.items()),
    )
    # a limit on the rank alone is applied before the shuffle, so a long session sends `steps` rows a task
    first = rows.filter(F.size("d") > 0).select("session", "line_no", "d").withColumn("_rank", F.row_number().over(Window.partitionBy("session").orderBy("line_no"))).filter(F.col("_rank") <= steps)
    made = made.join(first.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("line_no", "d"))).alias("d")), "session")
    found = F.array_distinct(F.flatten(F.transform("d", lambda x: x["d"])))
    names = lambda prefix, groups: F.array_compact(F.array(*(F.when(F.col(f"`{prefix}_{n}`"), n) for n, _ in groups)))
    category = F.coalesce(F.try_element_at(names("c", V.TASK_CATEGORIES), F.lit(1)), F.lit("general"))
    made = made.withColumn("steps", F.slice(found, 1, steps)).filter((F.col("event_count") >= least) & (F.size("steps") > 0))
    return made.select(
        stable_id(F.lit("skill"), "session").alias("id"),
        "session", "event_count", "requested",
        F.trim(F.regexp_replace(F.substring(F.coalesce("first_text", F.concat(category, F.lit("技能"))), 1, 60), "\n", " ")).alias("name"),
        category.alias("category"),
        "steps",
        names("t", V.REQUIRED_TOOLS).alias("required_tools"),
        F.slice(names("g", V.SUGGESTED_TAGS), 1, 8).alias("tags"),
        F.lit("draft").alias("status"),
    )


def skills_from_digests(digests_: DataFrame) -> DataFrame:
    """A skill for each digest with decisions: its steps are the decisions, then the code fragments."""
    steps = F.concat("key_decisions", F.transform("code", lambda c: F.concat(F.lit("```"), c["lang"], F.lit("\n"), c["code"], F.lit("\n```"))))
    return digests_.filter(F.size("key_decisions") > 0).select(stable_id(F.lit("skill"), "id").alias("id"), F.col("title").alias("name"), F.col("title").alias("trigger"), F.col("summary").alias("description"), steps.alias("steps"), "tags", F.lit("draft").alias("status"))


def repeated_patterns(digests_: DataFrame, least: int = 3) -> DataFrame:
    """(category, insights, keyword, count): for categories with `least` insights or more, the words of three characters
    or more that occur as often as half the number of insights; most frequent first is by count, then word."""
    rows = digests_.filter(F.col("status") == "active").select("category", F.explode("insights").alias("insight"))
    sizes = rows.groupBy("category").agg(F.count("*").alias("insights")).filter(F.col("insights") >= least)
    words = rows.select("category", F.explode(F.regexp_extract_all(F.lower("insight"), F.lit(r"([\p{L}\p{N}_]{3,})"), 1)).alias("keyword")).groupBy("category", "keyword").agg(F.count("*").alias("count"))
    return words.join(F.broadcast(sizes), "category").filter(F.col("count") >= F.floor(F.col("insights") / 2)).select("category", "insights", "keyword", "count")


def skills_from_patterns(digests_: DataFrame, least: int = 3, steps: int = 5) -> DataFrame:
    """A draft skill for each category whose insights share words (repeated_patterns): its steps are the category's first
    insights (by time, digest and place; 200 characters of each), its tags the category and its three most frequent words.

    The first steps and words are taken by limits on ranks, before anything is gathered; source_digests counts the digests.
    """
    words = repeated_patterns(digests_, least)
    place = lambda *order: F.row_number().over(Window.partitionBy("category").orderBy(*order))
    top = words.withColumn("_n", place(F.desc("count"), "keyword")).filter(F.col("_n") <= 3)
    tags = top.groupBy("category").agg(F.first("insights").alias("insights"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "keyword"))), lambda x: x["keyword"]).alias("words"))
    said = digests_.filter(F.col("status") == "active").select("category", "created_at", "id", F.posexplode("insights").alias("at", "insight"))
    first = said.withColumn("_n", place("created_at", "id", "at")).filter(F.col("_n") <= steps)
    first = first.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "insight"))), lambda x: F.substring(x["insight"], 1, 200)).alias("steps"))
    sources = said.groupBy("category").agg(F.countDistinct("id").alias("source_digests"))
    rows = tags.join(first, "category").join(sources, "category")
    return rows.select(
        stable_id(F.lit("pattern"), "category").alias("id"),
        F.concat(F.initcap("category"), F.lit(" 技能")).alias("name"),
        F.concat(F.lit("执行 "), "category", F.lit(" 相关任务")).alias("trigger"),
        F.concat(F.lit("从 "), F.col("insights").cast("string"), F.lit(" 个 Dream 的洞见中抽取的 "), "category", F.lit(" 技能")).alias("description"),
        "steps",
        F.concat(F.array("category"), "words").alias("tags"),
        F.col("category").alias("source_task_type"),
        F.lit(0.5).alias("confidence"),
        "source_digests",
        F.lit("draft").alias("status"),
    )


def questions(digests_: DataFrame) -> DataFrame:
    """(digest_id, question_no, question) of all follow-ups."""
    return digests_.select(F.col("id").alias("digest_id"), F.posexplode("follow_ups").alias("question_no", "question"))


def connections_of(edges_: DataFrame, memories: DataFrame | None = None, digests_: DataFrame | None = None) -> DataFrame:
    """The edges of some memories, of some digests, or of both (each a table of ids); all by semi-joins."""
    if memories is not None:
        edges_ = edges_.join(memories.select(F.col("id").cast("string").alias("memory_id")), "memory_id", "left_semi")
    if digests_ is not None:
        edges_ = edges_.join(digests_.select(F.col("id").alias("digest_id")), "digest_id", "left_semi")
    return edges_


def of_project(digests_: DataFrame, project: str) -> DataFrame:
    return digests_.filter((F.col("status") == "active") & (F.col("related_project") == project))


def recent(digests_: DataFrame, limit: int = 10) -> DataFrame:
    """The latest active digests; ties by id."""
    return digests_.filter(F.col("status") == "active").orderBy(F.desc("created_at"), "id").limit(limit)
