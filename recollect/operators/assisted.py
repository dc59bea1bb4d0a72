"""What a language model may do better than rules: memories, digests and skill steps out of its answers, rules where it has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.providers import FEWEST, MOST, Model, answers, json_in
from ..functions.text import stable_id
from ..sources.model import shared_folder, stored
from . import distill, wiki
from .digest import chunks, digests
from .ranks import numbered

#: Characters of a conversation that a prompt holds.
SHOWN = 4000
#: Failed uses of a skill that a prompt holds.
FAILURES = 10

_DIGEST = "struct<title:string,category:string,summary:string,insights:array<string>,sparks:array<struct<content:string,code_snippet:string,language:string,tags:array<string>>>,follow_ups:array<string>,key_decisions:array<string>>"
_MEMORIES = "struct<memories:array<struct<title:string,memory_type:string,scope:string,summary:string,hints:string,confidence:double,stability:double,tags:array<string>>>>"
_STEPS = "struct<steps:array<string>>"
_VERDICT = "struct<contradicts:boolean,reason:string>"


def _parsed(answer: Column, shape: str) -> Column:
    """The JSON object within an answer as a struct; null where there is none of this shape."""
    return F.from_json(json_in(answer), shape)


def _answers(rows: DataFrame, model: Model, folder: str | None, **calls) -> DataFrame:
    """rows (prompt) with `answer`, null where the model has none."""
    kept = folder or shared_folder(rows.sparkSession, "answers")
    found = stored(answers(rows, kept, model, **calls), "answered")
    return rows.join(found.withColumnRenamed("digest", "_d"), F.sha2("prompt", 256) == F.col("_d"), "left").drop("_d")


def model_digests(events: DataFrame, model: Model | None = None, folder: str | None = None, decision_words: Sequence[str] = V.DECISIONS, insight_words=(V.INSIGHT_MESSAGES, V.INSIGHT_SENTENCES), categories=V.CATEGORIES, follow_words: Sequence[str] = V.FOLLOW_UPS, **calls) -> DataFrame:
    """The digests of `digest.digests`, each with what a model's answer says of its chunk in place of what the rules say, and `made_by`.

    A prompt holds the messages of a chunk (20 at most) with their roles, SHOWN characters of them. An answer counts if it
    holds a JSON object with a title; of its lists 5 insights, 5 fragments, 3 follow-ups and 3 decisions are kept. Chunks
    without such an answer keep the digest of the rules, so no digest is lost.
    """
    plain = digests(events, decision_words, insight_words, categories, follow_words)
    if model is None:
        return plain.withColumn("made_by", F.lit("rules"))
    plain = stored(plain, "digests")
    said = F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("]: "), "text")
    lines = chunks(events).groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_no", said.alias("line")))), lambda x: x["line"]), "\n").alias("talk"))
    wanted = F.lit("Read the conversation and answer with one JSON object: title, category (exploration, creation, debug, learning or decision), summary, insights, sparks (content, code_snippet, language, tags), follow_ups, key_decisions.\n\n")
    asked = lines.select("chunk_id", F.concat(wanted, F.substring("talk", 1, SHOWN)).alias("prompt"))
    given = _answers(asked, model, folder, **calls).select("chunk_id", _parsed(F.col("answer"), _DIGEST).alias("m")).filter("trim(m.title) <> ''")
    rows = plain.join(given, "chunk_id", "left")
    none = F.array().cast("array<string>")
    known = F.col("m").isNotNull()
    first = lambda field, most: F.slice(F.filter(F.coalesce(f"m.{field}", none), lambda x: F.trim(x) != ""), 1, most)
    use = lambda new, old: F.when(known, new).otherwise(F.col(old)).alias(old)
    category = F.when(F.col("m.category").isin(*(n for n, _ in V.CATEGORIES), "exploration"), F.col("m.category")).otherwise(F.col("category"))
    sparks = F.slice(F.coalesce("m.sparks", F.array().cast("array<struct<content:string,code_snippet:string,language:string,tags:array<string>>>")), 1, 5)
    new = {
        "title": F.substring(F.trim("m.title"), 1, 60),
        "category": category,
        "summary": F.coalesce(F.nullif(F.trim("m.summary"), F.lit("")), "summary"),
        "insights": first("insights", 5),
        "follow_ups": first("follow_ups", 3),
        "key_decisions": first("key_decisions", 3),
        "fragments": F.transform(sparks, lambda x: F.coalesce(x["content"], F.lit(""))),
    }
    return rows.select(*(use(new[c], c) if c in new else F.col(c) for c in plain.columns), F.when(known, "model").otherwise("rules").alias("made_by"))


def model_memories(events: DataFrame, model: Model | None = None, folder: str | None = None, batch: int = 50, most: int = 20, fallback: bool = True, **rules) -> DataFrame:
    """Memories that a model draws from the events of users, `batch` of them (within 10 and 200) a prompt, with their evidence.

    Events are numbered by time over all ranges; a prompt holds a batch's texts in order. Of each answer the first `most`
    entries with a title, a summary and a known type and scope count. Their evidence is the first three events of the
    batch whose text stands in the summary or holds the title, else the answer itself. A memory is active if it is sure
    and steady enough, neither a profile, an episode nor a project's; else it needs review. One that several batches name
    comes once, the surest. Without a model, and with `fallback` where no answer names any memory, memories come from the
    rules (`rules`: words of distill.consolidate).
    """
    by_rules = lambda: distill.consolidate(events, **rules).select("id", "title", "memory_type", "scope", "tool", "summary", "details", "evidence", "confidence", "stability", "tags", "status").withColumn("managed_by", F.lit("system"))
    if model is None:
        return by_rules()
    size = max(FEWEST, min(batch, MOST))
    said = events.filter((F.col("role") == "user") & (F.trim("text") != "")).withColumn("_all", F.lit(0))
    said = stored(numbered(said, ["_all"], ["timestamp", "id"], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)), "said")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), "\n- ")
    wanted = F.lit("Which lasting facts, rules and preferences do these messages state? Answer with one JSON object: memories, a list of title, memory_type (profile, procedural, semantic or episodic), scope (global or project), summary, hints, confidence, stability, tags.\n- ")
    asked = said.groupBy("batch").agg(F.concat(wanted, text).alias("prompt"))
    given = _answers(asked, model, folder, batch=size).select("batch", F.explode(F.slice(_parsed(F.col("answer"), _MEMORIES)["memories"], 1, most)).alias("m")).select("batch", "m.*")
    fine = (F.trim("title") != "") & (F.trim("summary") != "") & F.col("memory_type").isin("profile", "procedural", "semantic", "episodic") & F.col("scope").isin("global", "project")
    held = given.filter(fine).withColumn("confidence", F.round(F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 3)).withColumn("stability", F.round(F.least(F.greatest(F.coalesce("stability", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 3))
    key = stable_id("memory_type", "scope", F.lit("shared"), F.lit(""), F.lower("title"))
    found = held.withColumn("id", key)
    rest = [c for c in found.columns if c != "id"]
    found = stored(found.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("confidence", "stability", -F.col("batch"))).alias("r")).select("id", "r.*"), "found")
    if fallback and found.isEmpty():
        return by_rules()
    events_ = said.withColumn("ord", F.col("_n")).select("id", "batch", "ord", "text", "source_tool", "session_id", "timestamp")
    matched = distill.matched_evidence(found, events_, "batch").join(events_.withColumnRenamed("id", "event_id").drop("batch", "ord"), "event_id")
    piece = lambda tool, session, at, what: F.struct(tool.alias("source_tool"), F.lit("llm_batch").alias("source_path"), session.alias("session_id"), at.alias("timestamp"), F.substring(what, 1, 220).alias("excerpt"))
    pieces = matched.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", piece(F.coalesce("source_tool", F.lit("llm")), F.col("session_id"), F.col("timestamp"), F.col("text")).alias("e")))), lambda x: x["e"]).alias("evidence"))
    none = F.lit(None).cast("string")
    own = F.array(piece(F.lit("llm"), none, none, F.coalesce("hints", "summary")))
    ready = (F.col("confidence") >= distill.AUTO_CONFIDENCE) & (F.col("stability") >= distill.AUTO_STABILITY) & ~F.col("memory_type").isin("profile", "episodic") & (F.col("scope") != "project")
    tags = F.array_sort(F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array("memory_type"), F.when(ready, F.array().cast("array<string>")).otherwise(F.array(F.lit("needs-review"))))))
    return found.join(pieces, "id", "left").select(
        "id", "title", "memory_type", "scope", F.lit("shared").alias("tool"), "summary", F.coalesce("hints", "summary").alias("details"), F.coalesce("evidence", own).alias("evidence"),
        "confidence", "stability", tags.alias("tags"), F.when(ready, "active").otherwise("candidate").alias("status"), F.lit("llm").alias("managed_by"),
    )


def model_steps(skills: DataFrame, feedback: DataFrame, model: Model | None = None, folder: str | None = None, **calls) -> DataFrame:
    """(id, at, steps): an improvement of each skill (id, name, trigger, description, steps) that has feedback (id, at, success, notes), for `lifecycle.improved_skills`.

    A prompt holds the skill and its last failures; an answer counts if it holds a JSON object with steps. Otherwise the
    steps stay and one is added that names the last note, 100 characters of it. `at` is the last feedback's.
    """
    notes = F.coalesce("notes", F.lit(""))
    last = feedback.groupBy("id").agg(F.max("at").alias("at"), F.max_by(notes, "at").alias("note"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at")))
    failed = feedback.filter("not success").select("id", "at", notes.alias("n")).withColumn("_n", place).filter(F.col("_n") <= FAILURES)
    failed = failed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_n"), F.concat(F.lit("- "), "n").alias("line")))), lambda x: x["line"]), "\n").alias("failures"))
    rows = skills.select("id", "name", "trigger", "description", "steps").join(last, "id").join(failed, "id", "left")
    plain = F.concat("steps", F.array(F.concat(F.lit("[改进] 根据反馈补充: "), F.substring("note", 1, 100))))
    if model is None:
        return rows.select("id", "at", plain.alias("steps"))
    listed = F.array_join(F.transform("steps", lambda x, i: F.concat_ws(". ", (i + 1).cast("string"), x)), "\n")
    prompt = F.concat(F.lit('Improve the steps of this skill and answer with one JSON object: {"steps": [...]}.\n'), F.concat_ws("\n", "name", "trigger", "description"), F.lit("\n"), listed, F.lit("\n"), F.coalesce("failures", F.lit("")))
    given = _answers(rows.withColumn("prompt", prompt), model, folder, **calls).withColumn("m", F.filter(_parsed(F.col("answer"), _STEPS)["steps"], lambda x: F.trim(x) != ""))
    return given.select("id", "at", F.when(F.size("m") > 0, F.col("m")).otherwise(plain).alias("steps"))


def model_contradictions(pairs: DataFrame, items: DataFrame, model: Model | None = None, folder: str | None = None, **calls) -> DataFrame:
    """(first_id, second_id, reason) of the pairs of memories that a model holds to contradict each other.

    pairs: (first_id, second_id), as wiki.conflicts gives them; only profiles and procedures of one type and scope are
    asked about. A pair without a clear answer, and every pair without a model, is judged by the rule that made it: it stays.
    """
    side = lambda n: items.select(F.col("id").alias(f"{n}_id"), F.struct("title", "summary", "memory_type", "scope").alias(n))
    rows = pairs.select("first_id", "second_id").distinct().join(side("first"), "first_id").join(side("second"), "second_id")
    kind = F.col("first.memory_type")
    rows = rows.filter(kind.isin("profile", "procedural") & (kind == F.col("second.memory_type")) & F.col("first.scope").eqNullSafe(F.col("second.scope")))
    if model is None:
        return rows.select("first_id", "second_id", F.lit("rule").alias("reason"))
    prompt = F.concat_ws("\n", F.lit('Would a user who follows both of these act against one of them? Answer with one JSON object: {"contradicts": true or false, "reason": "..."}.'), F.concat_ws(" | ", "first.title", "first.summary"), F.concat_ws(" | ", "second.title", "second.summary"))
    given = _answers(rows.withColumn("prompt", prompt), model, folder, **calls).withColumn("m", _parsed(F.col("answer"), _VERDICT))
    return given.filter(F.coalesce("m.contradicts", F.lit(True))).select("first_id", "second_id", F.when(F.col("m.contradicts").isNull(), "rule").otherwise(F.coalesce("m.reason", F.lit(""))).alias("reason"))


def contradicting(items: DataFrame, positive: Sequence[str] = V.POSITIVE, negative: Sequence[str] = V.NEGATIVE) -> DataFrame:
    """(id) of the memories that model_contradictions names without a model, of the conflicts of items, without their pairs."""
    asked = items.filter(F.col("memory_type").isin("profile", "procedural"))
    return wiki.conflict_members(asked, positive, negative, ("memory_type", "scope"))


def with_conflict_tags(items: DataFrame, contradictions: DataFrame) -> DataFrame:
    """items, those of a contradiction (pairs of ids, or ids) tagged `potential-conflict`; tags stay sorted and each once."""
    ids = contradictions if "id" in contradictions.columns else contradictions.select(F.explode(F.array("first_id", "second_id")).alias("id"))
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    rows = items.join(hit, "id", "left")
    tags = F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("potential-conflict"))))
    return rows.withColumn("tags", F.when(F.col("_hit"), tags).otherwise(F.col("tags"))).drop("_hit")
