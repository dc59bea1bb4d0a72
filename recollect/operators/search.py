"""Retrieval: BM25, vectors, their fusion, fallbacks, defaults and task contexts over memories."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col, count_terms, has_any_lower, query_terms
from ..sources.model import stored
from .segments import SearchIndex

#: Weights of a hit in each field, and the constants of BM25.
WEIGHTS = {"title": 3.0, "summary": 4.0, "details": 1.0, "tags": 1.5}
K1, B = 1.2, 0.75


def visible(scope: str | None = None, project: str | None = None, tool: str | None = None, statuses: Sequence[str] = ("active", "candidate")) -> Column:
    """Rows that a search may show: by status, scope, project (a key or the path of its folder; or none) and tool (or shared); None and all don't restrict."""
    project = project_label(project)
    fine = F.col("status").isin(*statuses)
    if scope and scope != "all":
        fine = fine & (F.col("scope") == scope)
    if project:
        fine = fine & ((F.col("project_key") == project) | F.col("project_key").isNull())
    if tool and tool != "all":
        fine = fine & F.col("tool").isin(tool, "shared")
    return fine


def project_label(project: str | None) -> str | None:
    """The key of a project that is given as its folder's path; keys and labels as they are (see text.project_reference)."""
    if not project or not re.search(r"[\\/:]|^~", project) or re.fullmatch(r"[a-z0-9-]+-[a-f0-9]{16}", project):
        return project or None
    plain = re.sub(r"/+$", "", os.path.expanduser(project).replace("\\", "/"))
    made = re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", (plain.split("/")[-1] or "project").strip().lower())) or "item"
    return f"{made}-{hashlib.sha1(plain.strip().encode()).hexdigest()[:16]}"


def has_tags(tags: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0 if tags else F.lit(True)


def priority(project: str | None, tool: str | None) -> Column:
    """0 active in the project, 1 active, shared and of no project, 2 active of the tool, 3 candidate in the project, 4 other."""
    active = F.col("status") == "active"
    in_project = (F.col("project_key") == project) if project else F.lit(False)
    of_tool = (F.col("tool") == tool) if tool and tool != "all" else F.lit(False)
    return F.when(in_project & active, 0).when(F.col("project_key").isNull() & (F.col("tool") == "shared") & active, 1).when(of_tool & active, 2).when(in_project & (F.col("status") == "candidate"), 3).otherwise(4)


def by_priority(project: str | None, tool: str | None) -> list[Column]:
    """The total order of results: priority, shared first, surer and steadier first, title, id."""
    return [priority(project, tool), F.when(F.col("tool") == "shared", 0).otherwise(1), F.desc("confidence"), F.desc("stability"), F.col("title"), F.col("id")]


def bm25(items: DataFrame, query: str, fields: Mapping[str, float] = WEIGHTS, key: str = "id", carry: Sequence[str] = ()) -> DataFrame:
    """(key, score) of the items that hold a term of the query: BM25 over weighted fields, terms joined by OR.

    Terms are counted within the row, each text lower-cased and read once, so no tokens are made or exploded. The counts,
    a few numbers for each item, are written to the shared folder; the statistics (rows, mean length, rows with each
    term; one row, broadcast) and the scores come from them. Fields named tags may be arrays.
    """
    terms = query_terms(query)
    if not terms:
        return items.select(key, *carry, F.lit(0.0).alias("score")).limit(0)
    text = lambda f: F.array_join(f, " ") if dict(items.dtypes)[f].startswith("array") else F.col(f)
    read = items.select(key, *carry, *(count_terms(text(f), terms).alias(f"_{i}") for i, f in enumerate(fields)))
    total = lambda j, weights: sum((F.element_at(f"_{i}", j) * w for i, w in enumerate(weights)), F.lit(0.0 if j > 1 else 0))
    counted = stored(read.select(key, *carry, total(1, [1] * len(fields)).alias("d"), *(total(j + 2, fields.values()).alias(f"f_{j}") for j in range(len(terms)))), "counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("d").alias("avg_d"), *(F.count_if(F.col(f"f_{j}") > 0).alias(f"df_{j}") for j in range(len(terms))))
    score = F.lit(0.0)
    for j in range(len(terms)):
        f, df = F.col(f"f_{j}"), F.col(f"df_{j}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * ((1 - B) + B * F.col("d") / F.col("avg_d")))
    found = F.lit(False)
    for j in range(len(terms)):
        found = found | (F.col(f"f_{j}") > 0)
    return counted.filter(found).join(F.broadcast(stats)).select(key, *carry, score.alias("score"))


def bm25_indexed(spark: SparkSession, folder: str, query: str, key: str = "id", buckets: int = 64) -> DataFrame:
    """(key, score) out of what `index.write_search_index` stored: the postings of the query's terms alone are read; statistics are those of all items.

    buckets: as the index was written. Frequencies of the terms and the corpus's statistics are a row for each term.
    """
    terms = query_terms(query)
    held = F.col("term").isin(*terms) & F.col("bucket").isin(*{zlib.crc32(t.encode()) % buckets for t in terms}) if terms else F.lit(False)
    hits = spark.read.parquet(f"{folder}/postings").filter(held)
    stats = spark.read.parquet(f"{folder}/lengths").agg(F.count("*").alias("n"), F.avg("d").alias("avg_d"))
    frequent = hits.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))
    f = F.col("weight")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    rows = hits.join(F.broadcast(frequent), "term").withColumn("score", idf * f * (K1 + 1) / (f + K1 * ((1 - B) + B * F.col("d") / F.col("avg_d"))))
    return rows.groupBy(key).agg(F.sum("score").alias("score"))


def normalized(scores: DataFrame, column: str = "score") -> DataFrame:
    """Scores over their greatest, 0 where that isn't above 0."""
    top = scores.agg(F.max(column).alias("_top"))
    return scores.join(F.broadcast(top)).withColumn(column, F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(0.0)).drop("_top")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is missing, empty or zero, or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def vector_scores(items: DataFrame, query: DataFrame | Sequence[float], vector: str = "embedding", key: str = "id") -> DataFrame:
    """(key, similarity): cosine of every item with one query vector (given, or the single row of a table, broadcast)."""
    if isinstance(query, DataFrame):
        one = query.select(F.col(query.columns[0]).alias("_q")).limit(1)
        return items.join(F.broadcast(one)).select(key, cosine(F.col(vector), F.col("_q")).alias("similarity")).filter("similarity is not null")
    return items.select(key, cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))).alias("similarity")).filter("similarity is not null")


def hybrid(items: DataFrame, text_scores: DataFrame, vector: DataFrame, alpha: float = 0.4, semantic: bool = False) -> DataFrame:
    """items with score, similarity and hybrid_score = alpha * score + (1 - alpha) * similarity, each of 0 where absent; items with neither are left out."""
    if semantic:
        alpha = max(0.0, alpha - 0.2)
    both = text_scores.join(vector, "id", "full_outer").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    return items.join(both, "id").withColumn("hybrid_score", F.col("score") * alpha + F.col("similarity") * (1 - alpha))


def keyword_fallback(items: DataFrame, query: str, limit: int, scope=None, project=None, tool=None) -> DataFrame:
    """Items whose title, summary or details hold the terms as one phrase; without terms all, active first. Over-fetched by certainty, then by priority."""
    phrase = " ".join(query_terms(query))
    rows = items.filter(visible(scope, project, tool))
    order = [F.desc("confidence"), F.desc("stability"), F.col("id")]
    if phrase:
        rows = rows.filter(has_any_lower("title", [phrase]) | has_any_lower("summary", [phrase]) | has_any_lower("details", [phrase]))
    else:
        order = [F.when(F.col("status") == "active", 0).otherwise(1), *order]
    return rows.orderBy(*order).limit(max(3 * limit, 20)).orderBy(*by_priority(project, tool)).limit(limit)


def memory_search(items: DataFrame, query: str, vectors: DataFrame | None = None, limit: int = 10, scope=None, project=None, tool=None, tags: Sequence[str] = (), alpha: float = 0.4, semantic: bool = False, index: SearchIndex | None = None) -> DataFrame:
    """The search: fusion of BM25 and vectors where both find something; where one does, what it finds by priority alone;
    else the keyword fallback.

    vectors: (id, similarity). index: what a SearchIndex keeps of the items; then no text is read, only postings' headers,
    the blocks that can matter and the stored columns of what is found (its columns without those that the index leaves
    out), and the items are looked at only if neither side finds anything. Without an index every text is read once, and
    the fallback is joined against the results (anti), so adaptive execution drops its scan where there are any.
    """
    fine, fetch = visible(scope, project, tool), max(3 * limit, 20)
    project = project_label(project)
    if index is None:
        rows = items.filter(fine & has_tags(tags))
        best = bm25(rows, query, carry=("confidence",)).orderBy(F.desc("score"), F.desc("confidence"), "id").limit(fetch).select("id", "score")
    else:
        rows = index.items().filter(fine & has_tags(tags))
        best = index.top(query, fetch, fine, has_tags(tags) if tags else None)
    # of an index a few rows that are known already; without one they are made once and kept
    keep = (lambda df, column, _: _few(df, column)) if index is not None else (lambda df, column, name: stored(normalized(df, column), name))
    text = keep(best, "score", "text")
    if vectors is None:
        vectors = text.select("id", F.lit(0.0).alias("similarity")).limit(0)
    shown = vectors.join(rows.select("id"), "id", "left_semi")
    near = keep(shown.orderBy(F.desc("similarity"), "id").limit(fetch), "similarity", "near")
    sides = text.agg((F.count("*") > 0).alias("_text")).join(near.agg((F.count("*") > 0).alias("_near")))
    found_ids = text.select("id").unionByName(near.select("id"))
    if index is not None:
        rows = index.fetch(found_ids.distinct())
    fused = F.when(F.col("_text") & F.col("_near"), F.round("hybrid_score", 4)).otherwise(0.0)
    merged = hybrid(rows, text, near, alpha, semantic).join(F.broadcast(sides)).withColumn("_fused", fused).drop("_text", "_near")
    found = merged.orderBy(F.desc("_fused"), *by_priority(project, tool)).limit(limit)
    zero = F.lit(0.0)
    if index is not None and not found_ids.isEmpty():
        return found.drop("_fused")
    none = found_ids.limit(1)
    columns = [c for c in items.columns if c in rows.columns]
    fallback = keyword_fallback(without(items.filter(fine & has_tags(tags)), none), query, limit, scope, project, tool).select(*columns, zero.alias("score"), zero.alias("similarity"), zero.alias("hybrid_score"), zero.alias("_fused"))
    # at most twice the limit are left to choose from
    return found.select(*fallback.columns).unionByName(fallback).orderBy(F.desc("_fused"), *by_priority(project, tool)).limit(limit).drop("_fused")


def without(rows: DataFrame, some: DataFrame) -> DataFrame:
    """All rows if the small table `some` is empty, else none."""
    return rows.join(F.broadcast(some.select(F.lit(1).alias("_some"))), F.lit(True), "left_anti")


def _few(rows: DataFrame, column: str) -> DataFrame:
    """A few rows (as many as a search fetches) as a table of the driver, a column over its greatest as in normalized()."""
    table = rows.toArrow()
    values = table.column(column).to_pylist()
    top = max(values, default=0.0)
    at = table.column_names.index(column)
    scaled = pa.array([v / top if top > 0 else 0.0 for v in values], pa.float64())
    return rows.sparkSession.createDataFrame(table.set_column(at, column, scaled), rows.schema)


def access_log(found: DataFrame, at: Column) -> DataFrame:
    """(id, accessed_at) of what a search returned, to be appended to the table of accesses."""
    return found.select("id", at.alias("accessed_at")).distinct()


def memory_context(items: DataFrame, query: str, vectors: DataFrame | None = None, project=None, tool=None, task_type: str = "", limit: int = 24, each: int = 8, alpha: float = 0.4, index: SearchIndex | None = None) -> DataFrame:
    """The context of a task: what a search for the query (else the kind of task, else the tool) finds, else the defaults, in sections."""
    found = memory_search(items, query or task_type or tool or "", vectors, limit, project=project, tool=tool, alpha=alpha, index=index)
    known = items if index is None else index.items()
    columns = [c for c in known.columns if c in found.columns]
    matched = stored(found.select(*columns), "matched")
    if index is not None and not matched.isEmpty():
        return context_sections(matched, project, tool, each)
    default = default_memories(without(known, matched.limit(1)), limit, project=project, tool=tool).select(*columns)
    return context_sections(matched.unionByName(default), project, tool, each)


def find(items: DataFrame, inbox: DataFrame, id_: object) -> DataFrame:
    """The item of an id, else what the inbox holds under it."""
    own = items.filter(F.col("id") == id_)
    return own.unionByName(without(inbox.filter(F.col("id") == id_), own.limit(1)).select(*items.columns))


def default_memories(items: DataFrame, limit: int, scope=None, project=None, tool=None) -> DataFrame:
    """What to know without a query: active items, procedures first, surer and steadier first, latest first; then by priority."""
    kind = F.when(F.col("memory_type") == "procedural", 0).when(F.col("memory_type") == "profile", 1).when(F.col("memory_type") == "semantic", 2).when(F.col("memory_type") == "episodic", 3).otherwise(4)
    rows = items.filter(visible(scope, project, tool, ("active",)))
    first = rows.orderBy(kind, F.desc("confidence"), F.desc("stability"), F.desc(F.coalesce("last_seen_at", "created_at")), "id").limit(max(3 * limit, 20))
    return first.orderBy(*by_priority(project, tool)).limit(limit)


def list_memories(items: DataFrame, limit: int = 50, status=None, scope=None, tool=None, project=None) -> DataFrame:
    """Items by exact status, scope, tool and project: candidates first, surer and steadier first, latest first."""
    rows = items
    for c, v in (("status", status), ("scope", scope), ("tool", tool), ("project_key", project)):
        if v and v != "all":
            rows = rows.filter(F.col(c) == v)
    rank = F.when(F.col("status") == "candidate", 0).when(F.col("status") == "active", 1).when(F.col("status") == "archived", 2).otherwise(3)
    return rows.orderBy(rank, F.desc("confidence"), F.desc("stability"), F.desc(F.coalesce("last_seen_at", "created_at")), "id").limit(limit)


def context_sections(matched: DataFrame, project=None, tool=None, each: int = 8) -> DataFrame:
    """(section, rank, item): rules to follow, preferences, patterns, warnings and episodes among the matched items, the first `each` by priority; an item may stand in several."""
    kind = F.col("memory_type")
    sections = F.array_compact(
        F.array(
            F.when((kind == "procedural") & (F.col("confidence") >= 0.82), "must_follow"),
            F.when(kind == "profile", "preferences"),
            F.when(kind == "semantic", "known_patterns"),
            F.when(F.array_contains("tags", "watchout"), "watch_outs"),
            F.when(kind == "episodic", "related_episodes"),
        )
    )
    rows = matched.withColumn("section", F.explode(sections))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(*by_priority(project, tool)))).filter(F.col("rank") <= each)


def suggestions(items: DataFrame, listed: int = 50, top: int = 5) -> DataFrame:
    """Candidates worth promoting: of the first listed candidates those of confidence 0.70 to 0.84, surest first."""
    return list_memories(items, listed, status="candidate").filter(F.col("confidence").between(0.70, 0.84)).orderBy(F.desc("confidence"), "id").limit(top)


def keyword_score(query: str, weights: Sequence[tuple[Column, float]], lists: Sequence[tuple[Column, float]]) -> Column:
    """Sum of the weights of the texts that hold the query, and for lists of texts of the weight for each that does; no case."""
    q = F.lit(query.lower())
    total = F.lit(0.0)
    for text, w in weights:
        total = total + F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), q), w).otherwise(0.0)
    for texts, w in lists:
        total = total + F.size(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), q))) * w
    return total


def search_digests(digests: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Active digests by where the query stands: title 3, summary 2, each insight 1.5, each fragment 1, category and each tag 0.5; without a query the latest."""
    active = digests.filter(F.col("status") == "active")
    if not query.strip():
        return active.orderBy(F.desc("created_at"), "id").limit(limit)
    score = keyword_score(query, [(F.col("title"), 3.0), (F.col("summary"), 2.0), (F.col("category"), 0.5)], [(F.col("insights"), 1.5), (F.col("fragments"), 1.0), (F.col("tags"), 0.5)])
    return active.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def search_skills(skills: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Active skills by where the query stands: name 4, trigger 3, description 2, each tag 1.5, each step 1; without a query the latest."""
    active = skills.filter(F.col("status") == "active")
    if not query.strip():
        return active.orderBy(F.desc("created_at"), "id").limit(limit)
    score = keyword_score(query, [(F.col("name"), 4.0), (F.col("trigger"), 3.0), (F.col("description"), 2.0)], [(F.col("tags"), 1.5), (F.col("steps"), 1.0)])
    return active.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def skill_match(skills: DataFrame, task: str, stop_words: Sequence[str], with_ratio: bool = True, limit: int = 5) -> DataFrame:
    """Skills that fit a task: 0.3 for each shared word, 1.5, 1 and 0.5 where a word stands in trigger, name or description,
    0.8 for each tag with a shared word, twice the text ratio with the trigger, and half the success rate; the first `limit`."""
    from ..functions.similarity import ratio

    words = sorted({w for w in re.findall(r"\w+", task.lower()) if len(w) >= 3 and w not in stop_words})
    lit_words = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    set_of = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    shared = F.size(F.array_intersect(lit_words, F.array_union(F.array_union(set_of("trigger"), set_of("name")), set_of("description"))))
    score = shared * 0.3
    for c, w in (("trigger", 1.5), ("name", 1.0), ("description", 0.5)):
        score = score + F.when(has_any_lower(c, words), w).otherwise(0.0)
    score = score + F.size(F.filter("tags", lambda t: F.arrays_overlap(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}_]+)"), 1), lit_words))) * 0.8
    score = score + F.coalesce(F.try_divide(F.col("success_count"), F.col("usage_count")), F.lit(0.0)) * 0.5
    if with_ratio:
        score = score + ratio(F.lit(task), F.col("trigger")) * 2.0
    return skills.filter(F.col("status") == "active").withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)
