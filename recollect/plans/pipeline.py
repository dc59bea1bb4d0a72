"""The whole way from transcripts to searchable memories, as tables in one folder."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import analytics, digest, distill, govern, index, render, wiki
from ..sources import transcripts
from ..operators.versions import Versions
from ..sources.model import stored


class Tables:
    """Parquet tables by name in a folder; a table that isn't there yet is None.

    Every write goes to a folder of its own, and one commit of the log switches any number of tables to their new folders
    at once: whoever reads, or fails in between, sees all of them before or after.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Versions(spark, f"{self.path}/log")

    def _live(self, name: str) -> list[str]:
        return [k for k in self.log.live() if k.startswith(f"{name}/")]

    def read(self, name: str) -> DataFrame | None:
        live = self._live(name)
        return self.spark.read.parquet(*(f"{self.path}/{k}" for k in live)) if live else None

    def replace(self, tables: Mapping[str, DataFrame]) -> None:
        """New rows in place of all that the named tables held; they may be made from the old ones."""
        added = {}
        for name, df in tables.items():
            folder = f"{name}/{uuid.uuid4().hex[:12]}"
            df.write.parquet(f"{self.path}/{folder}")
            added[folder] = 0
        self.log.commit(added, [k for name in tables for k in self._live(name)])

    def append(self, df: DataFrame, name: str) -> None:
        folder = f"{name}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{folder}")
        self.log.commit({folder: 0})


def collect(spark: SparkSession, tables: Tables, roots: Mapping[str, str]) -> DataFrame:
    """Append the events of the transcript folders that aren't known yet; returns all events."""
    events = transcripts.collect(spark, dict(roots))
    known = tables.read("raw_events")
    tables.append(events if known is None else index.insert_or_ignore(known, events), "raw_events")
    return tables.read("raw_events")


def consolidate(tables: Tables, events: DataFrame, **rules) -> DataFrame:
    """Distil memories, over the known ones, and govern the candidates."""
    made = distill.consolidate(events, **rules)
    known = tables.read("memories")
    if known is not None:
        fresh = distill.reconcile(made, known)
        made = index.upsert(known.select(fresh.columns), fresh)
    else:
        empty = made.filter("false").withColumn("created_at", F.lit("")).withColumn("reviewed_at", F.lit("")).withColumn("managed_by", F.lit("")).withColumn("manual_override", F.lit(False)).withColumn("expiration_days", F.lit(0))
        made = distill.reconcile(made, empty)
    judged = govern.govern(made).select("id", "new_status", "new_tags")
    made = made.join(judged, "id", "left").withColumn("status", F.coalesce("new_status", "status")).withColumn("tags", F.coalesce("new_tags", "tags")).drop("new_status", "new_tags")
    tables.replace({"memories": made})
    return tables.read("memories")


def run(spark: SparkSession, path: str, roots: Mapping[str, str], as_of: Column, **rules) -> dict[str, DataFrame]:
    """Collect, consolidate, digest, render and index; a second run over the same files changes nothing."""
    tables = Tables(spark, path)
    events = collect(spark, tables, roots)
    memories = consolidate(tables, events, **rules)
    active = memories.filter("status = 'active'")
    digests, known = stored(digest.digests(events), "digests"), tables.read("digests")
    fresh = digests if known is None else digest.new_digests(digests, known)
    issues = wiki.full_lint_report(active)
    pages = stored(wiki.pages(active, issues=issues).unionByName(wiki.front_pages(active, issues)), "pages")
    before = tables.read("pages")
    changes = stored(wiki.changed_pages(before if before is not None else pages.filter("false"), pages), "changes")
    skills, known_skills = digest.skills_from_digests(digests), tables.read("skills")
    if known_skills is not None:  # what a review or an improvement made of a skill stays
        skills = index.upsert(skills, known_skills)
    fresh = stored(fresh, "fresh")
    tables.append(fresh, "digests")
    edges = stored(digest.edges(digests, active, by_project=False), "edges")
    tables.replace({"pages": pages, "page_changes": changes, "skills": stored(skills, "skills"), "edges": edges, "project_links": digest.project_links(digests, active)})
    changed = tables.read("page_changes")
    routed = memories.withColumn("route", render.route())
    summary = analytics.summary(memories, events)
    return {"raw_events": events, "memories": routed, "digests": tables.read("digests"), "pages": tables.read("pages"), "page_changes": changed, "skills": tables.read("skills"), "edges": tables.read("edges"), "project_links": tables.read("project_links"), "summary": summary, "expired": govern.expired(memories.withColumn("created_at", F.to_timestamp("created_at")), as_of)}


#: Words that a run uses unless it is given others.
DEFAULT_RULES = {"keywords": V.EXPLICIT_KEYWORDS, "sensitive": V.SENSITIVE, "projects": V.PROJECT_HINTS}
