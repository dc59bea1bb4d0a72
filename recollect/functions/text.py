"""Text expressions: normalising, identifying and judging text, all as built-in column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once for a row, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(text: Column) -> Column:
    """Without the white space (of ASCII) at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def squash(text: Text) -> Column:
    """White space collapsed and stripped; null gives the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))


def excerpt(text: Text, limit: int = 220) -> Column:
    """One line of at most limit characters, the last three dots where it was cut."""
    return F.regexp_replace(squash(text), rf"(?s)^(.{{{limit - 3}}}).{{4,}}$", "$1...")


def stable_id(*parts: Text) -> Column:
    """First 16 hex digits of the SHA-1 of the stripped parts joined by ||; null parts are left out."""
    return F.substring(F.sha1(F.concat_ws("||", *(F.trim(col(p).cast("string")) for p in parts))), 1, 16)


def slug(text: Text) -> Column:
    """Lower case letters and digits, joined by single hyphens; `item` if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(text))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "item").otherwise(made)


def project_key(path: Text) -> Column:
    """slug of the last folder, a hyphen, and the stable id of the path with plain slashes; null and empty give null."""
    plain = F.regexp_replace(F.regexp_replace(col(path), r"\\", "/"), "/+$", "")
    last = F.element_at(F.split(plain, "/"), -1)
    return F.when(F.coalesce(col(path), F.lit("")) != "", F.concat(slug(F.when(last == "", "project").otherwise(last)), F.lit("-"), stable_id(plain)))


def project_reference(value: Text) -> Column:
    """A key stays, a path becomes its key, a label stays."""
    v = col(value)
    return F.when(v.rlike("^[a-z0-9-]+-[a-f0-9]{16}$"), v).when(v.rlike(r"[\\/:]|^~"), project_key(v)).otherwise(F.when(v != "", v))


def has_any(text: Text, words: Iterable[str]) -> Column:
    """Whether the text holds one of the words anywhere, as given."""
    listed = [w for w in words if w]
    if not listed:
        return F.lit(False)
    t = F.coalesce(col(text), F.lit(""))
    if len(listed) == 1:
        return F.contains(t, F.lit(listed[0]))
    # the text is worked out once, and each word looked for as plain bytes; one small expression however long the list
    return F.exists(F.array(t), lambda x: F.exists(F.array(*map(F.lit, listed)), lambda w: F.contains(x, w)))


def has_any_lower(text: Text, words: Iterable[str]) -> Column:
    """Whether the lower-cased text holds one of the lower-cased words."""
    return has_any(F.lower(F.coalesce(col(text), F.lit(""))), [w.lower() for w in words])


def first_match(text: Text, groups: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """Name of the first group of words of which the lower-cased text holds one."""
    out = F.lit(otherwise)
    for name, words in reversed(groups):
        out = F.when(has_any_lower(text, words), name).otherwise(out)
    return out


def all_matches(text: Text, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Names of all groups of which the lower-cased text holds a word, in the order of the groups."""
    return F.array_compact(F.array(*(F.when(has_any_lower(text, words), name) for name, words in groups)))


def is_garbled(text: Text) -> Column:
    """Signs of wrongly decoded text: known fragments, four question marks, or a letter or ideograph before a question mark that ends a word."""
    return once(F.coalesce(col(text), F.lit("")), _garbled)


def _garbled(t: Column) -> Column:
    return has_any(t, V.GARBLED) | F.contains(t, F.lit("????")) | (F.contains(t, F.lit("?")) & t.rlike(V.GARBLED_QUESTION))


def is_sensitive(text: Text, patterns: Sequence[str] = V.SENSITIVE) -> Column:
    return has_any_lower(text, patterns)


def sensitivity(text: Text, patterns: Sequence[str] = V.SENSITIVE) -> Column:
    return F.when(is_sensitive(text, patterns), "high").otherwise("low")


def _low_value(t: Column, stripped: Column, keyed: Column) -> Column:
    """As is_low_value(), of a text and the same stripped and lower-cased. Plain searches come before patterns."""
    slashes = F.length(t) - F.length(F.translate(t, "/\\", ""))
    return (
        (stripped == "")
        | F.startswith(stripped, F.lit("#"))
        | ((F.length(t) <= 10) & ~keyed)
        | has_any(stripped, V.PLAN_MARKERS)
        | has_any(stripped, V.LOW_VALUE)
        | has_any(t, V.TASK_REQUESTS)
        | (has_any(t, ("/", "\\")) & t.rlike(V.PATH_ONLY) & (slashes >= 2))
        | ((F.length(t) < 18) & t.rlike(V.GENERIC_TITLE))
        | _garbled(t)
        | (t.rlike(V.BULLET) & ~keyed)
        | (has_any(t, V.CODE_SIGNS) & t.rlike(V.CODE))
    )


def is_low_value(text: Text, keywords: Sequence[str] = ()) -> Column:
    """Text that teaches nothing: empty, garbled, a pasted plan, a request, a path, a heading, code, or a few characters."""
    return once(F.coalesce(col(text), F.lit("")), lambda t: once(F.lower(strip(t)), lambda s: _low_value(t, s, has_any_lower(t, keywords))))


def is_low_value_candidate(title: Text, summary: Text, details: Text) -> Column:
    text = F.concat_ws(" ", *(F.coalesce(col(x), F.lit("")) for x in (title, summary, details)))

    def judged(t: Column, lowered: Column) -> Column:
        slashes = F.length(lowered) - F.length(F.translate(lowered, "/\\", ""))
        words = F.size(F.filter(F.split(lowered, r"\s+"), lambda w: w != ""))
        low = once(strip(lowered), lambda s: _low_value(t, s, F.lit(False)))
        return has_any(lowered, V.LOW_VALUE_CANDIDATE) | low | (has_any(t, ("/", "\\")) & (slashes >= 4) & (words <= 8))

    return (F.length(squash(title)) < 8) | once(text, lambda t: once(F.lower(t), lambda lowered: judged(t, lowered)))


def is_high_value_note(text: Text) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    lowered = F.lower(F.regexp_replace(t, r"^\s+|\s+$", ""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return (F.length(lowered) >= 24) & ~is_garbled(t) & ~has_any(lowered, V.NOTE_LOW_VALUE) & ((lines >= 3) | has_any(lowered, V.HIGH_VALUE))


def is_lesson(text: Text) -> Column:
    lowered = F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"^\s+|\s+$", ""))
    first_person = F.startswith(lowered, F.lit("我")) & ~has_any(lowered, V.LESSON_FIRST_PERSON)
    return (F.length(lowered) >= 12) & ~has_any(lowered, V.LESSON_NOISE) & ~first_person & has_any(lowered, V.LESSON_SIGNALS)


def _accents() -> tuple[str, str]:
    """Lower-case letters that are an ASCII letter with marks, then marks of their own; the ASCII letters that stand for the former."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    plain = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and d[0].islower() and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in plain) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in plain)


#: What searches take off letters, as a translation: from each of the first to the one at its place in the second; the rest goes.
ACCENTS = _accents()


def folded(text: Text) -> Column:
    """Lower case without accents, as searches compare text; null gives the empty string."""
    return F.translate(F.lower(F.coalesce(col(text), F.lit(""))), *ACCENTS)


def tokens(text: Text) -> Column:
    """Runs of letters and digits of the folded text, repeats included."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def count_terms(text: Text, terms: Sequence[str]) -> Column:
    """How many tokens() there are, then how often each folded term is one, as an array, without making tokens; terms
    that a text doesn't hold anywhere cost one plain search."""

    def counts(t: Column) -> Column:
        whole = lambda term: F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{term}\E(?![\p{{L}}\p{{N}}])")
        return F.array(F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+")), *(F.when(F.contains(t, F.lit(x)), F.regexp_count(t, whole(x))).otherwise(0) for x in terms))

    return once(folded(text), counts)


def query_terms(query: str) -> list[str]:
    """Distinct folded terms of a query in their order."""
    letters, plain = ACCENTS
    table = {ord(c): plain[i] if i < len(plain) else None for i, c in enumerate(letters)}
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower().translate(table))))


def token_set(text: Text) -> Column:
    """Distinct ASCII words of three characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("([a-z0-9_]+)"), 1), lambda w: F.length(w) > 2))


def polarity(text: Text, positive: Sequence[str] = V.POSITIVE, negative: Sequence[str] = V.NEGATIVE) -> Column:
    """1 for text that asks, -1 for text that forbids, 0 for neither or both."""
    yes, no = has_any_lower(text, positive), has_any_lower(text, negative)
    return F.when(yes & ~no, 1).when(no & ~yes, -1).otherwise(0)


def note_type(text: Text, rules: Sequence[tuple[str, Sequence[str]]] = V.NOTE_TYPES) -> Column:
    """The type with most words found; ties go to the earlier, none to null."""
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    hits = [F.struct(sum((F.contains(lowered, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(rules)]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["name"])


def note_confidence(text: Text, kind: Text, has_project: Column, role: Text) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    points = [(F.length(t) >= 120, 8), (lines >= 3, 12), (has_any_lower(t, V.SECTION_TOKENS), 12), (col(kind).isin("计划", "决策", "复盘"), 8), (has_project, 8), (col(role) == "assistant", 4)]
    total = sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(55))
    return F.least(total, F.lit(98)) / 100.0


def clean_project_label(value: Text) -> Column:
    """A key without its hash, separators as spaces, words capitalised unless all capitals."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(value), "-[a-f0-9]{16}$", ""), "[_-]", " "), " +", " "))
    word = lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(F.split(plain, " "), word), " ")


def is_poor_project_name(key: Text, name: Text) -> Column:
    n = F.lower(F.trim(col(name)))
    return (n == F.lower(F.trim(col(key)))) | n.rlike("[a-f0-9]{12,}") | n.isin("path", "project", "repo", "workspace", "unknown")


def safe_folder(value: Text) -> Column:
    made = F.regexp_replace(F.trim(F.regexp_replace(col(value), r'[<>:"/\\|?*]+', "-")), r"^\.+|\.+$", "")
    return F.when(made == "", "未命名项目").otherwise(made)


def safe_file(value: Text) -> Column:
    made = F.substring(F.regexp_replace(F.regexp_replace(squash(value), r'[<>:"/\\|?*]+', "-"), r"\.+$", ""), 1, 80)
    return F.when(made == "", "未命名").otherwise(made)


def code_blocks(text: Text) -> Column:
    """Fenced code: array of struct(lang, code), code of 500 characters at most, lang `code` where none is named."""
    t = F.coalesce(col(text), F.lit(""))
    pattern = F.lit(r"```([\p{L}\p{N}_]*)\n([\s\S]*?)```")
    langs, codes = F.regexp_extract_all(t, pattern, 1), F.regexp_extract_all(t, pattern, 2)
    return F.transform(F.arrays_zip(langs.alias("l"), codes.alias("c")), lambda x: F.struct(F.when(x["l"] == "", "code").otherwise(x["l"]).alias("lang"), F.substring(F.trim(x["c"]), 1, 500).alias("code")))


def sentences_with(text: Text, word: Column, end: str, least: int, cut: int) -> Column:
    """Sentences longer than least that hold the word (lower-cased), as excerpts."""
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), end), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    kept = F.filter(parts, lambda s: F.contains(F.lower(s), word) & (F.length(s) > least))
    return F.transform(kept, lambda s: excerpt(s, cut))
