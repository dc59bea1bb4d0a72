"""Transcript files of several tools as raw events, read line by line with built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import project_key, stable_id
from .model import stored

ROLES = ("user", "assistant", "developer", "system")
COLUMNS = ("id", "source_tool", "source_path", "session_id", "event_type", "timestamp", "role", "cwd", "project_key", "text", "command", "raw_json")


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(source_path, line_no, raw_json): lines that hold a JSON object, numbered from 0 within their whole file.

    A byte-order mark, blank lines and malformed lines do no harm; line numbers count all lines, so that they stay when
    a file grows. Files are read in splits by many tasks: lines are counted by split, the counts of a file's earlier
    splits are added up, and a line's number is that sum and its place in its split. The lines are written to the shared
    folder first, so that files which grow meanwhile are read once.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", "\n")
    split = {"source_path": "file_path", "_split": "file_block_start"}
    found = reader.text(path).select(*(F.col(f"_metadata.{m}").alias(c) for c, m in split.items()), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r$", "").alias("raw_json"))
    found = stored(found, "lines")
    sizes = found.groupBy("source_path", "_split").agg(F.count("*").alias("_count"), F.min("_at").alias("_first"))
    before = F.sum("_count").over(Window.partitionBy("source_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0)) - F.col("_first")).drop("_count", "_first")
    found = found.join(sizes, ["source_path", "_split"]).withColumn("line_no", (F.col("_at") + F.col("_before")).cast("int"))
    return json_lines(found.select("source_path", "line_no", "raw_json"))


def json_lines(found: DataFrame) -> DataFrame:
    """The rows whose raw_json is a JSON object, byte-order marks taken off."""
    found = found.withColumn("raw_json", F.regexp_replace("raw_json", "^\\x{FEFF}", ""))
    return found.filter(F.expr("try_parse_json(raw_json) is not null") & F.trim("raw_json").startswith("{"))


def whole_files(spark: SparkSession, path: str, glob: str = "*.{txt,md}", tool: str = "text") -> DataFrame:
    """Each text file as one user message, its session the file's stem."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    return _events(files.withColumn("line_no", F.lit(0)).withColumn("raw_json", F.col("text")), tool, "message", _stem(), F.lit("user"), F.col("text"))


def manual_notes(spark: SparkSession, path: str, glob: str = "*.{md,txt,json,yaml,yml}") -> DataFrame:
    """Notes written by hand; the id is that of the path and the first 120 characters."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    made = _events(files.withColumn("line_no", F.lit(0)).withColumn("raw_json", F.col("text")), "manual", "manual_note", _stem(), F.lit("user"), F.col("text"))
    return made.withColumn("id", stable_id("source_path", F.substring("text", 1, 120)))


def frontmatter(text: Column) -> Column:
    """Map of the key: value lines between leading --- marks; empty without them."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))))


def _stem() -> Column:
    return F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1)


def _get(*paths: str) -> Column:
    """The first of the JSON paths that gives text that isn't empty."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object("raw_json", p)), F.lit("")) for p in paths))


def _joined(path: str, kind: str | None = None) -> Column:
    """Texts of an array of chunks, joined by newlines; a plain string stays."""
    raw = F.get_json_object("raw_json", path)
    chunks = F.from_json(raw, "array<struct<type:string,text:string>>")
    kept = F.filter(chunks, lambda c: (F.coalesce(c["text"], F.lit("")) != "") & ((c["type"] == kind) if kind else F.lit(True)))
    plain = F.from_json(raw, "array<string>")
    strings = F.when(~F.startswith(F.element_at(plain, 1), F.lit("{")), F.array_join(plain, "\n"))
    joined = F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda c: c["text"]), "\n"))
    return F.nullif(F.trim(F.when(raw.startswith("["), F.coalesce(joined, strings)).otherwise(raw)), F.lit(""))


def _events(df: DataFrame, tool: str, kind: Column | str, session: Column, role: Column, text: Column, timestamp: Column | None = None, cwd: Column | None = None, command: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    df = df.select(
        "source_path",
        "line_no",
        "raw_json",
        F.lit(tool).alias("source_tool"),
        session.alias("session_id"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"),
        (none if timestamp is None else timestamp).alias("timestamp"),
        role.alias("role"),
        (none if cwd is None else cwd).alias("cwd"),
        text.alias("text"),
        (none if command is None else command).alias("command"),
    )
    df = df.withColumn("project_key", project_key("cwd")).withColumn("id", stable_id("source_tool", "source_path", F.col("line_no").cast("string"), "event_type", "text", "command"))
    return df.select(*COLUMNS, "line_no")


#: Lines of a file in one range of it.
RANGE = 1 << 16


def carried(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """df with the last value before or at each line of its file that isn't null, for each of some columns.

    Lines are taken by ranges of RANGE line numbers: values are carried within a range, the last ones of each range (a row
    for each) over the file's ranges, and what a range begins with is joined to its lines. So a file of any length is
    spread over tasks.
    """
    rows = df.withColumn("_range", F.floor(F.col("line_no") / RANGE)).withColumns({f"_v_{n}": v for n, v in values.items()})
    within = Window.partitionBy("source_path", "_range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("source_path", "_range").agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("line_no"))).alias(f"_e_{n}") for n in values))
    before = Window.partitionBy("source_path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("source_path", "_range", *(F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in values))
    held = rows.withColumns({f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(within) for n in values}).join(begins, ["source_path", "_range"])
    return held.select(*df.columns, *(F.coalesce(f"_l_{n}", f"_b_{n}").alias(n) for n in values))


def codex_history(df: DataFrame) -> DataFrame:
    text = _get("$.text")
    return _events(df.filter(text.isNotNull()), "codex", "history_user_text", F.coalesce(_get("$.session_id"), _stem()), F.lit("user"), text, _get("$.ts"))


def codex_session(df: DataFrame) -> DataFrame:
    """Messages and tool calls; folder and session come from the last session_meta line before, in line order within the file."""
    meta = _get("$.type") == "session_meta"
    df = carried(df, {"cwd_": F.when(meta, _get("$.payload.cwd")), "session_": F.when(meta, _get("$.payload.id"))})
    kind = _get("$.payload.type")
    items = df.filter(_get("$.type") == "response_item")
    text, role = _joined("$.payload.content"), _get("$.payload.role")
    messages = _events(items.filter((kind == "message") & role.isin(*ROLES) & text.isNotNull()), "codex", "message", F.coalesce("session_", _stem()), role, text, _get("$.timestamp"), F.col("cwd_"))
    name, args = _get("$.payload.name", "$.payload.tool_name"), _get("$.payload.arguments", "$.payload.args")
    command, folder = F.get_json_object(args, "$.command"), F.get_json_object(args, "$.workdir")
    calls = _events(items.filter(kind.isin("function_call", "tool_call")), "codex", "tool_use", F.coalesce("session_", _stem()), F.lit("assistant"), name, _get("$.timestamp"), F.coalesce(folder, "cwd_"), command)
    return messages.unionByName(calls)


def claude_transcript(df: DataFrame) -> DataFrame:
    text = _joined("$.content")
    said = _events(df.filter((_get("$.type") == "user") & text.isNotNull()), "claude", "message", _stem(), F.lit("user"), text, _get("$.timestamp"))
    used = _events(df.filter(_get("$.type") == "tool_use"), "claude", "tool_use", _stem(), F.lit("assistant"), _get("$.tool_name"), _get("$.timestamp"), _get("$.tool_input.workdir"), _get("$.tool_input.command"))
    return said.unionByName(used)


def cursor_transcript(df: DataFrame) -> DataFrame:
    """Text chunks of users and assistants, without an assistant's thoughts; the folder is three levels up."""
    role, text = _get("$.role"), _joined("$.message.content", "text")
    thought = (role == "assistant") & F.startswith(F.ltrim(text), F.lit("<think>"))
    cwd = F.regexp_extract("source_path", r"^(?:file:)?(?://)?(.*)/[^/]+/[^/]+/[^/]+$", 1)
    return _events(df.filter(role.isin("user", "assistant") & text.isNotNull() & ~thought), "cursor", "message", _stem(), role, text, _get("$.timestamp"), cwd)


def generic_jsonl(df: DataFrame) -> DataFrame:
    role = _get("$.role", "$.type")
    text, command = F.coalesce(_joined("$.text"), _joined("$.content"), _joined("$.message")), _get("$.command")
    kind = F.when(command.isNotNull(), "tool_use").otherwise("message")
    return _events(df.filter(text.isNotNull() | command.isNotNull()), "generic", kind, F.coalesce(_get("$.session_id", "$.conversation_id"), _stem()), F.when(role.isin(*ROLES), role).otherwise("user"), text, _get("$.timestamp", "$.ts"), _get("$.cwd", "$.workdir"), command)


#: Parser by tool; further tools are read as generic lines, or bring a parser of their own.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"codex_history": codex_history, "codex": codex_session, "claude": claude_transcript, "cursor": cursor_transcript, "generic": generic_jsonl}


def collect(spark: SparkSession, roots: dict[str, str], parsers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All events of the tools' folders; the first of each id stays."""
    parsers = PARSERS | (parsers or {})
    found = None
    for tool, path in sorted(roots.items()):
        events = parsers.get(tool, generic_jsonl)(lines(spark, path)).withColumn("source_tool", F.lit(tool))
        found = events if found is None else found.unionByName(events)
    return first_of_each(found, "id", "source_path", "line_no")


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by an order; the minimum is taken before rows are shuffled."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)
