"""Repair of the structure of conversations: the cheapest edits that make turns alternate, and their audit.

Edits of a row are Keep, Rerole and Delete; rows may be Inserted anywhere. A dynamic program over the rows keeps, for
each of the four places in the pattern `(s?(ua)+)?`, the cheapest audit (the edits' initials) that leads there. Audits
are persistent: a node is one edit and points to the node before, so that audits share their prefixes; it knows its
rolling hash and its ancestors at powers of two. Of equally cheap audits the least in ASCII order stays: their longest
common prefix is searched by hashes of ancestors, and what the hashes call equal is compared before it is believed.
Audits of equal cost that lead to the same place have as many K, R and D, so none of them is a proper prefix of another
and their order stays when both go on.

Rows are dealt by ranges of (conversation, turn), so a conversation that holds a third of all rows is spread over many
tasks. A conversation that lies within one task is solved there. Of those at a task's borders every chunk of rows
gives the cheapest audits from each place to each place; these are chained over the chunks, one after the other, and
each chunk then repairs its own rows. Only the digest of a whole repaired conversation passes through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_texts, materialize

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What a truncated row costs unless it is deleted.
TRUNCATED = 3
#: Rows and characters of a chunk of a conversation, about.
CHUNK_ROWS, CHUNK_CHARS = 512, 64 << 10

#: Places in the pattern: nothing yet, after s, after u, after a. Audits end at the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The place that the next u or a leads to, by the place before.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}

_SPACE = " \t\n\x0b\x0c\r"
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Strings that share their prefixes: nodes of one piece each, linked to the node before. Node 0 is the empty string."""

    def __init__(self, base: int = _BASE) -> None:
        self.base = base
        self.piece, self.level, self.hash, self.up = [""], [0], [0], [(0,)]

    def extend(self, node: int, piece: str) -> int:
        """A new node: the string of `node`, then `piece`."""
        up, i, above = [node], 0, node
        while i < len(self.up[above]) and above:
            above = self.up[above][i]
            up.append(above)
            i += 1
        value = hash(piece) % _MOD if len(piece) > 1 else ord(piece) if piece else 7
        self.piece.append(piece)
        self.level.append(self.level[node] + 1)
        self.hash.append((self.hash[node] * self.base + value) % _MOD)
        self.up.append(tuple(up))
        return len(self.piece) - 1

    def ancestor(self, node: int, level: int) -> int:
        """The prefix of the node that has so many pieces."""
        while (rest := self.level[node] - level) > 0:
            up = self.up[node]
            node = up[min(rest.bit_length() - 1, len(up) - 1)]
        return node

    def shared(self, x: int, y: int) -> int:
        """The number of pieces that the nodes have in common at their start."""
        level = min(self.level[x], self.level[y])
        x, y = self.ancestor(x, level), self.ancestor(y, level)
        a, b = x, y
        if self.hash[a] != self.hash[b]:
            while True:
                for i in range(min(len(self.up[a]), len(self.up[b])) - 1, -1, -1):
                    p, q = self.up[a][i], self.up[b][i]
                    if self.hash[p] != self.hash[q] and self.level[p] == self.level[q]:
                        a, b = p, q
                        break
                else:
                    a, b = self.up[a][0], self.up[b][0]
                    break
        found = self.level[a]
        while a != b:  # the prefixes that the hashes call equal, until they are one node
            if self.piece[a] != self.piece[b]:
                found = self.level[a] - 1
            a, b = self.up[a][0], self.up[b][0]
        return found

    def pieces(self, node: int, level: int = 0) -> list[str]:
        """The pieces after the first `level` ones."""
        out = []
        while self.level[node] > level:
            out.append(self.piece[node])
            node = self.up[node][0]
        return out[::-1]

    def text(self, node: int, level: int = 0) -> str:
        return "".join(self.pieces(node, level))

    def less(self, x: int, y: int) -> bool:
        """Whether x comes before y in the order of their characters."""
        if x == y:
            return False
        level = self.shared(x, y)
        return self.text(x, level) < self.text(y, level)


Best = list[tuple[int, int] | None]


def _offer(audits: Audits, best: Best, place: int, cost: int, node: int, piece: str) -> None:
    """Let (cost, node and piece) be the best at a place if it is cheaper, or as cheap and less."""
    was = best[place]
    if was is None or cost <= was[0]:
        new = audits.extend(node, piece) if piece else node
        if was is None or cost < was[0] or audits.less(new, was[1]):
            best[place] = (cost, new)


def with_inserts(audits: Audits, best: Best) -> Best:
    """The best audits after any inserts: one of a user or an assistant, or one of each."""
    out = list(best)
    for place, b in enumerate(best):
        if b is None:
            continue
        one = NEXT[place]
        _offer(audits, out, one, b[0] + INSERT, b[1], "I")
        if place in (START, SYSTEM):
            _offer(audits, out, NEXT[one], b[0] + 2 * INSERT, audits.extend(b[1], "I"), "I")
    return out


def step(audits: Audits, best: Best, initial: str, must_go: bool, truncated: bool) -> Best:
    """The best audits after one more row, inserts behind it included."""
    out: Best = [None] * 4
    more = TRUNCATED if truncated else 0
    for place, b in enumerate(best):
        if b is None:
            continue
        cost, node = b
        _offer(audits, out, place, cost + DELETE, node, "D")
        if must_go:
            continue
        to = NEXT[place]
        if initial == ("a" if place == USER else "u"):
            _offer(audits, out, to, cost + KEEP + more, node, "K")
        elif initial == "s" and place == START:
            _offer(audits, out, SYSTEM, cost + KEEP + more, node, "K")
        _offer(audits, out, to, cost + REROLE + more, node, "R")
    return with_inserts(audits, out)


Row = tuple[int | None, str, str]


class Chunk:
    """Consecutive rows of a conversation: their faults, and what has to be known of them."""

    def __init__(self, rows: list[Row], late: set[int] = frozenset(), seen: set[tuple[str, str]] | None = None) -> None:
        """late: rows that are known to repeat an earlier one; seen: (role, text) of earlier rows."""
        seen = set() if seen is None else seen
        self.rows, self.faults = rows, []
        for i, (_, role, text) in enumerate(rows):
            bare = text.rstrip(_SPACE)
            repeat = i in late or (role, text) in seen
            seen.add((role, text))
            self.faults.append("blank" if not bare else "duplicate" if repeat else "truncated" if bare[-1] not in ".!?" else "")
        self.initials = [role[:1] for _, role, _ in rows]

    def counts(self) -> tuple[int, int, int, int]:
        """blank, duplicate, truncated, and pairs of neighbours that no conversation has."""
        pairs = sum(x + y not in ("su", "ua", "au") for x, y in zip(self.initials, self.initials[1:], strict=False))
        return self.faults.count("blank"), self.faults.count("duplicate"), self.faults.count("truncated"), pairs

    def turns(self) -> tuple[int | None, int | None, int]:
        """Smallest and greatest turn, and the number of different ones; rows are in order."""
        turns = [t for t, _, _ in self.rows if t is not None]
        return (turns[0], turns[-1], len(set(turns))) if turns else (None, None, 0)

    def solve(self, place: int, audits: Audits, first: bool = False) -> Best:
        """The best audits from a place to each place; first: with inserts before the first row."""
        best: Best = [None] * 4
        best[place] = (0, 0)
        if first:
            best = with_inserts(audits, best)
        for initial, fault in zip(self.initials, self.faults, strict=True):
            best = step(audits, best, initial, fault in ("blank", "duplicate"), fault == "truncated")
        return best

    def repaired(self, place: int, audit: str) -> list[tuple[str, int | None, str | None, str]]:
        """(edit, number of the row, role after it, text) of each edit of an audit that begins at a place; role None: deleted."""
        out, i = [], 0
        for edit in audit:
            if edit == "I":
                place = NEXT[place]
                out.append((edit, None, NAMES[place], ""))
                continue
            _, role, text = self.rows[i]
            if edit == "D":
                out.append((edit, i, None, text))
            else:
                place = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[place]
                out.append((edit, i, role if edit == "K" else NAMES[place], text))
            i += 1
        return out


def _cheapest(audits: Audits, best: Best) -> int:
    """The place at which the cheapest whole audit ends, of equal ones the least."""
    ends = [p for p in ENDS if best[p] is not None]
    least = ends[0]
    for p in ends[1:]:
        if best[p][0] < best[least][0] or best[p][0] == best[least][0] and audits.less(best[p][1], best[least][1]):
            least = p
    return least


def _lines(repaired: list[tuple[str, int | None, str | None, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for _, _, role, text in repaired if role is not None).encode()


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_EDIT = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_REPORT = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
_REPORT_SQL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_KEY = [("conv", pa.int64()), ("noid", pa.bool_())]
_AT = [("part", pa.int32()), ("chunk", pa.int32())]


def repair(rows: DataFrame, gone: str | None = None, edits_out: bool = False) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256; with edits_out, `edits` in rows.

    rows: conv_id, turn, role, text; gone: a boolean column of rows that aren't there but whose conversation is to be
    listed. Rows are taken by turn (nulls first), of equal turns by role and text. A row's first fault counts: blank (no
    character but white space), duplicate (role and text come earlier), truncated (the last character that isn't white
    space is none of `.!?`). gaps: turns missing between the smallest and the greatest; illegal: neighbours whose roles'
    initials aren't su, ua or au. Null roles and texts count as one space, rows without conv_id are a conversation of
    their own with a null id, a conversation without rows has zeros, an empty audit and the digest of nothing; an empty
    table gives no rows; other columns are ignored.

    edits_out: instead of one row a conversation, one for each chunk of it: (conv_id, part, chunk, edits), the chunks in
    order by part and chunk; edits array<struct<edit, turn, role, text>> hold each edit, the role after it and the text,
    with a null role where the row is deleted.
    """
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    keyed = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("noid"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
        F.substring(text, 1, 32).alias("head"),
    )
    order = ["noid", "conv", F.col("turn").asc_nulls_first(), "role", "head"]
    ranged = long_texts(keyed).repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("head")

    portion = pa.schema([*_KEY, *_REPORT, ("audit", pa.string()), ("sha", pa.string()), *_AT, ("rows", pa.list_(_ROW)), ("edits", pa.list_(_EDIT)), ("keys", pa.list_(pa.binary()))])

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole conversations solved; those at the partition's borders, and long ones, as chunks."""
        part = TaskContext.get().partitionId()
        key, held, chars, number, first, out = None, [], 0, 0, True, []

        def opened() -> dict:
            keys = list(dict.fromkeys(_digest(r) for r in held))
            return {"conv": key[0], "noid": key[1], "part": part, "chunk": number, "rows": [dict(zip(("turn", "role", "text"), r, strict=True)) for r in held], "keys": keys}

        def solved() -> dict:
            chunk, audits = Chunk(held), Audits()
            best = chunk.solve(START, audits, True)
            end = _cheapest(audits, best)
            audit = audits.text(best[end][1])
            edits = chunk.repaired(START, audit)
            low, high, n = chunk.turns()
            report = [high - low + 1 - n if n else 0, *chunk.counts(), best[end][0]]
            listed = [{"edit": e, "turn": None if i is None else held[i][0], "role": r, "text": t} for e, i, r, t in edits] if edits_out else None
            return {"conv": key[0], "noid": key[1], **dict(zip((c for c, _ in _REPORT), report, strict=True)), "audit": audit, "sha": hashlib.sha256(_lines(edits)).hexdigest(), "edits": listed}

        def rows_out(force: bool = False) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) >= 500 or sum(len(r.get("rows") or ()) for r in out[-1:]) >= CHUNK_ROWS):
                yield pa.RecordBatch.from_pylist(out, schema=portion)
                out.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    if key is not None:
                        out.append(opened() if first or number else solved())
                        yield from rows_out()
                        first = False
                    key, held, chars, number = row[:2], [], 0, 0
                if row[5]:
                    continue
                if len(held) >= CHUNK_ROWS or chars >= CHUNK_CHARS:
                    out.append(opened())
                    yield from rows_out()
                    held, chars, number = [], 0, number + 1
                held.append(row[2:5])
                chars += len(row[4])
        if key is not None:
            out.append(opened())
        yield from rows_out(True)

    sql_rows = "array<struct<turn:long,role:string,text:string>>"
    sql_edits = "array<struct<edit:string,turn:long,role:string,text:string>>"
    cut = materialize(ranged.mapInArrow(portions, f"conv long, noid boolean, {_REPORT_SQL}, sha string, part int, chunk int, rows {sql_rows}, edits {sql_edits}, keys array<binary>"), "portions")
    key, at = ["conv", "noid"], ["conv", "noid", "part", "chunk"]
    done, chunks = cut.filter("part is null"), cut.filter("part is not null").select(*at, "rows", "keys")

    # which rows repeat one of an earlier chunk: the first row of each key within a chunk is told
    told = chunks.select(*at, F.posexplode("keys").alias("nth", "k"))
    earliest = told.groupBy(*key, "k").agg(F.min(F.struct("part", "chunk")).alias("first"))
    late = told.join(earliest, [*key, "k"]).filter("part > first.part or chunk > first.chunk").groupBy(*at).agg(F.collect_list("nth").alias("late"))
    chunks = materialize(chunks.drop("keys").join(late, at, "left"), "chunks")

    summary = pa.schema([*_KEY, *_AT, ("counts", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each chunk, and the best audits from each place to each place (cost -1: none)."""
        for batch in batches:
            for row in batch.to_pylist():
                chunk, costs, texts = _chunk(row), [], []
                for place in range(4):
                    audits = Audits()
                    for b in chunk.solve(place, audits):
                        costs.append(-1 if b is None else b[0])
                        texts.append("" if b is None else audits.text(b[1]))
                ends = [chunk.initials[0], chunk.initials[-1]] if chunk.rows else []
                made = {c: row[c] for c in at} | {"counts": chunk.counts(), "turns": chunk.turns(), "ends": ends, "costs": costs, "audits": texts}
                yield pa.RecordBatch.from_pylist([made], schema=summary)

    link = pa.schema([*_KEY, *_AT, ("place", pa.int32()), ("piece", pa.string()), *_REPORT, ("audit", pa.string())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cheapest audit over the chunks of each conversation, as they pass by: each chunk's place to begin and its part of the audit."""
        now: Chain | None = None
        for batch in batches:
            made: list[dict] = []
            for row in batch.to_pylist():
                if now is None or now.key != (row["conv"], row["noid"]):
                    if now is not None:
                        made += now.finish()
                    now = Chain(row["conv"], row["noid"])
                made += now.add(row)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=link)
        if now is not None:
            yield pa.RecordBatch.from_pylist(now.finish(), schema=link)

    links = chunks.mapInArrow(summaries, "conv long, noid boolean, part int, chunk int, counts array<long>, turns array<long>, ends array<string>, costs array<long>, audits array<string>")
    links = links.repartition(*key).sortWithinPartitions(*at).mapInArrow(chain, f"conv long, noid boolean, part int, chunk int, place int, piece string, {_REPORT_SQL}")
    links = materialize(links, "links")

    text_ = pa.schema([*_KEY, *_AT, ("lines", pa.binary()), ("edits", pa.list_(_EDIT))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                edits = _chunk(row).repaired(row["place"], row["piece"])
                lines = None if edits_out or all(r is None for _, _, r, _ in edits) else _lines(edits)
                listed = [{"edit": e, "turn": None if i is None else row["rows"][i]["turn"], "role": r, "text": t} for e, i, r, t in edits] if edits_out else None
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in at} | {"lines": lines, "edits": listed}], schema=text_)

    applied = chunks.join(links.select(*at, "place", "piece"), at).mapInArrow(apply, f"conv long, noid boolean, part int, chunk int, lines binary, edits {sql_edits}")
    conv_id = F.when(~F.col("noid"), F.col("conv")).alias("conv_id")
    if edits_out:
        whole = done.select("conv", "noid", F.lit(0).alias("part"), F.lit(0).alias("chunk"), "edits")
        return whole.unionByName(applied.drop("lines")).select(conv_id, "part", "chunk", "edits")

    digest = pa.schema([*_KEY, ("sha", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest of each conversation's lines, as they pass by."""
        key_, state, began = None, None, False
        for batch in batches:
            for row in batch.to_pylist():
                if (row["conv"], row["noid"]) != key_:
                    if key_ is not None:
                        yield pa.RecordBatch.from_pylist([{"conv": key_[0], "noid": key_[1], "sha": state.hexdigest()}], schema=digest)
                    key_, state, began = (row["conv"], row["noid"]), hashlib.sha256(), False
                if row["lines"] is not None:
                    state.update(b"\n" + row["lines"] if began else row["lines"])
                    began = True
        if key_ is not None:
            yield pa.RecordBatch.from_pylist([{"conv": key_[0], "noid": key_[1], "sha": state.hexdigest()}], schema=digest)

    hashed = applied.drop("edits").repartition(*key).sortWithinPartitions(*at).mapInArrow(digests, "conv long, noid boolean, sha string")
    columns = [*(c for c, _ in _REPORT), "audit"]
    solved = links.filter("audit is not null").select(*key, *columns).join(hashed, key)
    return done.select(*key, *columns, "sha").unionByName(solved.select(*key, *columns, "sha")).select(conv_id, *columns, F.col("sha").alias("repaired_sha256"))


def _digest(row: Row) -> bytes:
    role = row[1].encode()
    return hashlib.blake2b(len(role).to_bytes(8, "big") + role + row[2].encode(), digest_size=16).digest()


def _chunk(row: dict) -> Chunk:
    """The chunk of a row; rows that repeat one of an earlier chunk are told by the number of their key."""
    rows = [(r["turn"], r["role"], r["text"]) for r in row["rows"]]
    keys = list(dict.fromkeys((r[1], r[2]) for r in rows))
    return Chunk(rows, seen={keys[i] for i in row["late"] or ()})


class Chain:
    """The audits of one conversation over its chunks. What all live audits share is settled and leaves at once, but for its letters."""

    def __init__(self, conv: int, noid: bool) -> None:
        self.key, self.audit = (conv, noid), []
        self.audits = Audits()
        self.best = with_inserts(self.audits, [(0, 0), None, None, None])
        # inserts before the first row belong to the first chunk
        self.before = {b[1]: self.audits.text(b[1]) for b in self.best if b is not None}
        self.audits, self.best = Audits(), [None if b is None else (b[0], -b[1]) for b in self.best]
        self.open: list[dict] = []
        self.begin: dict[int, int] = {}
        self.counts, self.low, self.high, self.turns, self.last = [0] * 4, None, None, 0, None

    def add(self, row: dict) -> list[dict]:
        """One more chunk; the rows of chunks that are settled by it."""
        self._count(row)
        first, new = not self.open and not self.audit, [None] * 4
        for s, b in enumerate(self.best):
            if b is None:
                continue
            for t in range(4):
                cost, was = b[0] + row["costs"][4 * s + t], new[t]
                if row["costs"][4 * s + t] >= 0 and (was is None or cost <= was[0]):
                    piece = row["audits"][4 * s + t]
                    node = self.audits.extend(0, self.before[-b[1]] + piece) if first else self.audits.extend(b[1], piece)
                    self.begin[node] = START if first else s
                    if was is None or cost < was[0] or self.audits.less(node, was[1]):
                        new[t] = (cost, node)
        self.best = new
        self.open.append({c: row[c] for c in ("conv", "noid", "part", "chunk")})
        return self._settle()

    def _settle(self) -> list[dict]:
        live = {b[1] for b in self.best if b is not None}
        while len(live) > 1:
            live = {self.audits.up[n][0] for n in live}
        shared = live.pop()
        if shared and self.audits.level[shared] == len(self.open):
            shared = self.audits.up[shared][0]
        if not shared:
            return []
        out = self._told(shared)
        level, fresh, begin, moved = self.audits.level[shared], Audits(), {}, {shared: 0}
        for i, b in enumerate(self.best):
            if b is None:
                continue
            path, n = [], b[1]
            while n != shared:
                path.append(n)
                n = self.audits.up[n][0]
            for n in reversed(path):
                if n not in moved:
                    moved[n] = fresh.extend(moved[self.audits.up[n][0]], self.audits.piece[n])
                    begin[moved[n]] = self.begin[n]
            self.best[i] = (b[0], moved[b[1]])
        self.audits, self.begin, self.open = fresh, begin, self.open[level:]
        return out

    def _told(self, node: int) -> list[dict]:
        path = []
        while node:
            path.append(node)
            node = self.audits.up[node][0]
        path.reverse()
        self.audit += [self.audits.piece[n] for n in path]
        return [row | {"place": self.begin[n], "piece": self.audits.piece[n]} for row, n in zip(self.open, path, strict=False)]

    def _count(self, row: dict) -> None:
        self.counts = [x + y for x, y in zip(self.counts, row["counts"], strict=True)]
        if row["ends"]:
            self.counts[3] += self.last is not None and self.last + row["ends"][0] not in ("su", "ua", "au")
            self.last = row["ends"][1]
        low, high, n = row["turns"]
        if low is not None:
            self.turns += n - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def finish(self) -> list[dict]:
        """The rows of the chunks that are left; the last one has the report and the whole audit."""
        end = _cheapest(self.audits, self.best)
        cost, node = self.best[end]
        out = self._told(node)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        out[-1] |= dict(zip((c for c, _ in _REPORT), [gaps, *self.counts, cost], strict=True)) | {"audit": "".join(self.audit)}
        return out


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: conversations with faults put in by a checksum of `conv_id:turn` modulo 20 (nulls: one space):
    0 marks the row as gone, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text: Column = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return convs.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("copy")).drop("copy")
