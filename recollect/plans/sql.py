"""Pieces of DuckDB SQL that say the same as the column expressions of the library."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from ..functions import vocabulary as V
from ..functions.text import ACCENTS
from ..sources.model import MEMORIES_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squash(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def excerpt(x: str, limit: int) -> str:
    return f"(CASE WHEN length({squash(x)}) > {limit} THEN substr({squash(x)}, 1, {limit - 3}) || '...' ELSE {squash(x)} END)"


def any_of(x: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains(coalesce({x}, ''), {q(w)})" for w in words) + ")" if words else "false"


def any_lower(x: str, words: Iterable[str]) -> str:
    return any_of(f"lower({x})", [w.lower() for w in words])


def first_match(x: str, groups: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_lower(x, words)} THEN {q(name)}" for name, words in groups) + f" ELSE {q(otherwise)} END"


def garbled(x: str) -> str:
    return f"({any_of(x, V.GARBLED)} OR contains(coalesce({x}, ''), '????') OR regexp_matches(coalesce({x}, ''), {q(V.GARBLED_QUESTION)}))"


def low_value(x: str, keywords: Sequence[str] = ()) -> str:
    lowered = rf"lower(regexp_replace({x}, '^\s+|\s+$', '', 'g'))"
    keyed = any_lower(x, keywords) if keywords else "false"
    seps = rf"(length({x}) - length(regexp_replace({x}, '[/\\]', '', 'g')))"
    m = lambda p: f"regexp_matches({x}, {q(p)})"
    return (
        f"({lowered} = '' OR {garbled(x)} OR {any_of(lowered, V.PLAN_MARKERS)} OR {any_of(lowered, V.LOW_VALUE)} OR {any_of(x, V.TASK_REQUESTS)} OR ({m(V.PATH_ONLY)} AND {seps} >= 2)"
        f" OR starts_with({lowered}, '#') OR ({m(V.BULLET)} AND NOT {keyed}) OR ({m(V.GENERIC_TITLE)} AND length({x}) < 18) OR {m(V.CODE)} OR (length({x}) <= 10 AND NOT {keyed}))"
    )


def low_candidate(title: str, summary: str, details: str) -> str:
    text = f"(coalesce({title}, '') || ' ' || coalesce({summary}, '') || ' ' || coalesce({details}, ''))"
    lowered = f"lower({text})"
    slashes = rf"(length({lowered}) - length(regexp_replace({lowered}, '[/\\]', '', 'g')))"
    words = rf"len(list_filter(regexp_split_to_array({lowered}, '\s+'), lambda w: w <> ''))"
    return f"({low_value(text)} OR {any_of(lowered, V.LOW_VALUE_CANDIDATE)} OR length({squash(title)}) < 8 OR ({slashes} >= 4 AND {words} <= 8))"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(translate(lower(coalesce({x}, '')), {q(ACCENTS[0])}, {q(ACCENTS[1])}), '[\p{{L}}\p{{N}}]+')"


def token_set(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_]+'), lambda w: length(w) > 2))"


def stable_id(*parts: str) -> str:
    return f"substr(sha1(concat_ws('||', {', '.join(f'trim({p}::VARCHAR)' for p in parts)})), 1, 16)"


def slug(x: str) -> str:
    made = f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"(CASE WHEN {made} = '' THEN 'item' ELSE {made} END)"


def when_s(seconds: str) -> str:
    """ISO time of whole seconds."""
    return f"strftime(make_timestamp(({seconds})::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"


def visible(scope=None, project=None, tool=None, statuses=("active", "candidate")) -> str:
    parts = [f"status IN ({', '.join(map(q, statuses))})"]
    if scope and scope != "all":
        parts.append(f"scope = {q(scope)}")
    if project:
        parts.append(f"(project_key = {q(project)} OR project_key IS NULL)")
    if tool and tool != "all":
        parts.append(f"tool IN ({q(tool)}, 'shared')")
    return " AND ".join(parts)


def priority(project: str | None, tool: str | None) -> str:
    in_project = f"coalesce(project_key = {q(project)}, false)" if project else "false"
    of_tool = f"tool = {q(tool)}" if tool and tool != "all" else "false"
    first = f"CASE WHEN {in_project} AND status = 'active' THEN 0 WHEN project_key IS NULL AND tool = 'shared' AND status = 'active' THEN 1 WHEN {of_tool} AND status = 'active' THEN 2 WHEN {in_project} AND status = 'candidate' THEN 3 ELSE 4 END"
    return f"{first}, CASE WHEN tool = 'shared' THEN 0 ELSE 1 END, confidence DESC, stability DESC, title, id"


MEMORIES = MEMORIES_SQL.format(title=excerpt("d.text", 60), summary=excerpt("d.text", 180))

EVENTS = f"""raw_events AS (
  SELECT {stable_id('conv_id', 'turn', 'role', 'text')} AS id, 'chat' AS source_tool, 'conversations/' || conv_id AS source_path, conv_id::VARCHAR AS session_id,
    {when_s('1704067200 + conv_id * 3600 + turn * 60')} AS timestamp, role, CASE WHEN conv_id % 3 <> 0 THEN 'team-' || (conv_id % 10) END AS project_key, text, turn AS line_no
  FROM conversations
)"""
