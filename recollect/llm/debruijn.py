"""Removal of repeated word sequences over a de Bruijn graph of word windows, held and compacted in Spark.

Every window of k words is an edge of the graph (from its first k - 1 words to its last k - 1). Only edges that occur
in two documents or more matter, and they are found in two steps so that few of them have to be shuffled. The least
hash of the m-word sequences inside a window (its minimizer) stands for it first: equal windows have equal minimizers,
and neighbouring windows mostly share theirs, so only a quarter as many values meet, and the windows over minimizers
that occur in one document only are out. The windows left over then meet by their own hash, and each learns the
smallest document, and the place in it, that it occurs in: its source coordinates.

Edges that follow each other in a document and in its source are strung together where they lie, in the buckets. The
strings of all buckets meet in Spark joins by their source: wherever one begins or ends, documents part ways, so the
joins cut there and leave the paths without branches of the whole graph, each once. A path is then joined with its
source document, whose words come back with it, and a word goes only if the words of the path are the document's own.

Documents are dealt once into buckets of a few megabytes. A bucket sends each hash once (twice if several of its own
documents hold it) whatever the number of copies, so a passage that a third of all documents share weighs as much as
there are buckets, and answers go to buckets, not to documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import run_bounds

#: Bytes of text in a bucket of documents, and hashes in a group that meets, about.
BUCKET_BYTES, GROUP_HASHES = 2 << 20, 200_000
#: Words of a source that are one key where strings meet its cuts.
SPAN = 512

#: XXH64's primes, and seeds of the two hashes of a word.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED, CHECK_SEED = 42, 43
_STEP = np.uint64(0xA0761D6478BD642F)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _P2
    x ^= x >> np.uint64(29)
    x *= _P3
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start:end] for each word, all words of a length at once; from 32 bytes on by the library."""
    from xxhash import xxh64_intdigest

    raw = data + bytes(8)
    one, four, eight = (np.ndarray((len(raw) - 7,), t, raw, strides=(1,)) for t in ("u1", "<u4", "<u8"))
    sizes = ends - starts
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")
    cuts = np.searchsorted(np.minimum(sizes, 32)[order], np.arange(34))
    out = np.empty(len(starts), np.uint64)
    for size in range(1, 32):
        own = order[cuts[size] : cuts[size + 1]]
        if not len(own):
            continue
        at = starts[own]
        h = np.full(len(own), (seed + int(_P5) + size) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for _ in range(size // 8):
            h = _turn(h ^ (_turn(eight[at] * _P2, 31) * _P1), 27) * _P1 + _P4
            at = at + 8
        if size % 8 >= 4:
            h = _turn(h ^ (four[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at = at + 4
        for _ in range(size % 4):
            h = _turn(h ^ (one[at].astype(np.uint64) * _P5), 11) * _P1
            at = at + 1
        out[own] = _mix(h)
    for i in order[cuts[32] :].tolist():
        out[i] = xxh64_intdigest(data[starts[i] : ends[i]], seed)
    return out


class Words:
    """The words of some texts laid end to end: where each begins and ends, its text, and its 64-bit hash."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        space = _SPACES[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = (edge[::2], edge[1::2]) if space[0] else (np.r_[0, edge[1::2]], edge[::2])
        if len(self.starts) > len(self.ends):
            self.starts = self.starts[: len(self.ends)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.cumsum(sizes) - sizes
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.hash = word_hashes(self.data, self.starts, self.ends, SEED)
        #: first word of each text, and the number of words at the end
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (k - 1 fewer than there are words)."""
        return _run_hashes(self.hash, np.arange(max(len(self.hash) - k + 1, 0)), k)

    def checks(self, k: int, at: np.ndarray) -> np.ndarray:
        """32 further bits for the k words from each word in `at` on, from hashes of the words of their own."""
        other = word_hashes(self.data, self.starts, self.ends, CHECK_SEED)
        return (_run_hashes(other, at, k) >> np.uint64(32)).astype("<u4")

    def windows(self, k: int) -> np.ndarray:
        """First words of the windows of k words that lie in one text."""
        n = len(self.hash) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def minimizers(self, k: int, m: int) -> np.ndarray:
        """For each k words from a word on, the least hash of m words among them."""
        least, width = self.runs(m), 1
        span = k - m + 1
        while width < span:
            step = min(width, span - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        return least


def _run_hashes(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out += words[at + j] if len(at) < len(words) - k + 1 else words[j : j + len(at)]
        out *= _STEP
        out ^= out >> np.uint64(29)
    return _mix(out)


def _texts(table: pa.Table) -> list[bytes]:
    return pc.fill_null(table.column("text").cast(pa.binary()), b"").to_pylist()


def _sliced(group: np.ndarray, of: int, columns: dict[str, np.ndarray], schema: pa.Schema, by: str = "part") -> pa.Table:
    """A row for each value of group, with its share of every column as bytes, in the order given: unsigned numbers as
    they are, signed ones as differences of one to five bytes or more. The group is the column `by`, `of` the other one."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = run_bounds(group)
    made: dict = {}
    for name, values in columns.items():
        raw, at = _packed(values[order], cuts) if values.dtype.kind == "i" else (values[order].tobytes(), cuts * values.itemsize)
        made[name] = [raw[x:y] for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)]
    made |= {by: group[cuts[:-1]].astype(np.int64), "bucket" if by == "part" else "part": [of] * (len(cuts) - 1)}
    return pa.Table.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)


def _packed(x: np.ndarray, cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Differences of x, from 0 at each cut, seven bits a byte with the sign last, and where the bytes of each cut begin."""
    step = np.diff(x.astype(np.int64), prepend=0)
    step[cuts[:-1]] = x[cuts[:-1]]
    rest = (step << 1 ^ step >> 63).view(np.uint64)
    size = np.ones(len(x), np.int64)
    for bits in range(7, 64, 7):
        more = rest >> np.uint64(bits) > 0
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(x) else 0, np.uint8)
    for i in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > i)
        out[end[own] - size[own] + i] = (rest[own] >> np.uint64(7 * i) & np.uint64(127)).astype(np.uint8) | np.where(size[own] > i + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), np.r_[0, end][cuts]


def _numbers(column: pa.ChunkedArray, kind: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of blobs, of an unsigned kind or packed, and how many each row holds."""
    rows = column.to_pylist()
    raw = np.frombuffer(b"".join(rows), kind or np.uint8)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    if kind or not len(raw):
        return raw if kind else np.zeros(0, np.int64), lengths // raw.itemsize
    last = raw < 128
    start = np.flatnonzero(np.r_[True, last[:-1]])
    shift = (np.arange(len(raw)) - np.repeat(start, np.diff(np.r_[start, len(raw)]))).astype(np.uint64) * np.uint64(7)
    value = np.add.reduceat((raw & 127).astype(np.uint64) << shift, start)
    total = np.cumsum((value >> np.uint64(1)).view(np.int64) ^ -(value & np.uint64(1)).view(np.int64))
    counts = np.diff(np.r_[0, np.cumsum(last)[np.cumsum(lengths) - 1]])
    before = np.cumsum(counts) - counts
    return total - np.repeat(np.where(before > 0, total[before - 1], 0), counts), counts


def compact(w: np.ndarray, doc: np.ndarray, source_doc: np.ndarray, source_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, start, end): repeated windows that follow each other in a document and in its source are one path; head is
    the number of its first window, start and end are its words. w ascending, doc: of each window."""
    if not len(w):
        return w, w, w
    heads = np.flatnonzero(np.r_[True, (np.diff(w) != 1) | (np.diff(source_doc) != 0) | (np.diff(source_at) != 1) | (np.diff(doc) != 0)])
    tails = np.r_[heads[1:], len(w)] - 1
    return heads, w[heads], w[tails] + k


class Bucket:
    """The rows of a bucket by doc_id: their words, ids, and the first word of the first row that has the same id."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.texts = _texts(self.table)
        self.words = Words(self.texts)
        self.ids = pc.fill_null(self.table.column("doc_id"), -1).to_numpy()
        self.base = self.words.first[np.searchsorted(self.ids, self.ids)]


def compact_paths(strings: DataFrame) -> DataFrame:
    """Strings of edges cut into the paths without branches that all strings together leave, n edges from `start` on, and
    a row with n = 0 where a string ends (for the words under its last edge).

    strings: (bucket, doc, start, n, source_doc, source_start). Where a string begins or ends in its source, some
    document enters or leaves the graph, so no path goes across. The cuts of a source are as many as its words at most.

    Strings are cut at every SPAN words of their source first, and each piece meets the cuts of its span alone: a source
    that many strings come from is as many keys as it has spans, and no string is held against the cuts of a whole
    document. Pieces end at the borders of spans as well.
    """
    span = lambda x: F.floor(x / SPAN).cast("int")
    last = F.col("source_start") + F.col("n")
    edge_of = F.explode(F.array("source_start", last))
    cuts = strings.select("source_doc", edge_of.alias("cut")).distinct().groupBy("source_doc", span(F.col("cut")).alias("span")).agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    pieces = strings.withColumn("span", F.explode(F.sequence(span(F.col("source_start")), span(last))))
    pieces = pieces.withColumn("low", F.greatest("source_start", F.col("span") * SPAN)).withColumn("high", F.least(last, (F.col("span") + 1) * SPAN))
    within = F.expr("filter(cuts, c -> c > low and c < high)")
    # where the string itself ends, a row without edges
    ends = F.when(F.col("low") < F.col("high"), F.concat(F.array("low"), F.coalesce(within, F.array().cast("array<int>")))).otherwise(F.array().cast("array<int>"))
    borders = F.concat(ends, F.when(F.col("span") == span(last), F.array(last, last)).otherwise(F.array("high")))
    parts = pieces.join(cuts, ["source_doc", "span"], "left").withColumn("at", borders)
    step = F.expr("transform(slice(at, 1, size(at) - 1), (x, i) -> struct(x as begin, at[i + 1] - x as edges))")
    paths = parts.withColumn("path", F.explode(step))
    return paths.select("bucket", "doc", (F.col("start") + F.col("path.begin") - F.col("source_start")).alias("start"), F.col("path.edges").alias("n"), "source_doc", F.col("path.begin").alias("source_start"))


def _confirmed(bucket: Bucket, w: np.ndarray, place: np.ndarray, source: bytes, k: int) -> np.ndarray:
    """Which of the windows w have the words that stand at the source; place: of each window's first word in `source`, words joined by one space."""
    words, ok = bucket.words, np.zeros(len(w), bool)
    cuts = np.r_[0, np.flatnonzero(np.frombuffer(source, np.uint8) == 32) + 1, len(source) + 1]
    heads = np.flatnonzero(np.r_[True, (np.diff(w) != 1) | (np.diff(place) != 1)][: len(w)])

    def same(i: int, j: int) -> bool:
        """Whether the words under windows i to j - 1 are those at the source."""
        own = words.data[words.starts[w[i]] : words.ends[w[j - 1] + k - 1]]
        other = source[cuts[place[i]] : cuts[place[j - 1] + k] - 1]
        return own == other or b" ".join(own.split()) == other

    for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(w)], strict=True):
        ok[i:j] = True if same(i, j) else [same(x, x + 1) for x in range(i, j)]
    return ok


def remove_repeats(docs: DataFrame, k: int = 13, m: int = 7, text_out: bool = False, spans: bool = False, row: bool = False) -> DataFrame:
    """Remove every word under a window of k words whose words also start somewhere in a document with a smaller doc_id.

    Windows are judged on the input. Returns for each row doc_id, n_words, n_removed, kept_sha256 (kept words, joined by
    one space), then `kept` (text_out: the text itself where nothing goes, else the kept words joined by one space),
    `spans` (spans: compacted paths of repeated windows: first word, end, document and first word of the source) and
    `row` (row: all columns of the row but doc_id and text, as they were, in one struct, so that no names clash). Null
    and empty texts have no words, and texts of fewer than k words lose none. Rows with equal doc_id don't judge each
    other, rows without one neither judge nor lose words. An empty table gives no rows; other columns are ignored.

    Hashes of windows have 64 bits and meet together with 32 further ones from word hashes of another seed; whatever
    they say, no word goes unless its window's words stand at the source coordinates.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    parts = max(1, size // 24 // GROUP_HASHES)
    bucket_of = lambda doc: F.pmod(F.xxhash64(doc), F.lit(buckets))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole: list[Column] = [F.struct(*(F.col(f"`{c}`") for c in rest) if rest else [F.lit(None).cast("int").alias("none")]).alias("row")] if row else []
    kept_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *whole)
    dealt = kept_in.withColumn("bucket", F.when(F.col("doc_id").isNotNull(), bucket_of("doc_id")).otherwise(buckets + bucket_of("text")).cast("int")).repartition("bucket")
    by_bucket, part_of = dealt.groupBy("bucket"), np.uint64(parts)

    first = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary())])
    second = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("checks", pa.binary()), ("docs", pa.binary()), ("at", pa.binary())])
    answer = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("docs", pa.binary()), ("at", pa.binary()), ("source_docs", pa.binary()), ("source_at", pa.binary())])
    string = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("source_doc", pa.int64()), ("source_start", pa.int32())])
    spoken = pa.schema([("source_doc", pa.int64()), ("source_start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])

    def minimizers(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:  # rows without doc_id
            return first.empty_table()
        words, ids = Words(_texts(table)), table.column("doc_id").to_numpy()
        w = words.windows(k)
        least, doc = words.minimizers(k, m)[w], ids[words.doc[w]]
        new = np.flatnonzero((least[1:] != least[:-1]) | (doc[1:] != doc[:-1])) + 1 if len(w) else w
        least, doc = least[np.r_[0, new]] if len(w) else least, doc[np.r_[0, new]] if len(w) else doc
        order = np.lexsort((doc, least))
        least, doc = least[order], doc[order]
        fresh = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])][: len(least)]
        least = least[fresh]
        # each once for one document, twice for more
        keep = np.r_[True, True, least[2:] != least[:-2]][: len(least)]
        return _sliced(least[keep] % part_of, table.column("bucket")[0].as_py(), {"hashes": least[keep]}, first)

    def repeated(table: pa.Table) -> pa.Table:
        hashes, counts = _numbers(table.column("hashes"), "<u8")
        bucket = np.repeat(table.column("bucket").to_numpy(), counts)
        order = np.argsort(hashes, kind="stable")
        hashes, bucket = hashes[order], bucket[order]
        same = hashes[1:] == hashes[:-1]
        often = np.r_[same, False] | np.r_[False, same] if len(hashes) else np.zeros(0, bool)
        hashes, bucket = hashes[often], bucket[often]
        return _sliced(bucket, table.column("part")[0].as_py(), {"hashes": hashes}, first, by="bucket")

    def candidates(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return second.empty_table()
        held = Bucket(table)
        words, ids = held.words, held.ids
        w = words.windows(k)
        least = words.minimizers(k, m)[w]
        known = np.unique(_numbers(replies.column("hashes"), "<u8")[0])
        found = known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least if len(known) else np.zeros(len(w), bool)
        w = w[found]
        hashes, doc = words.runs(k)[w], ids[words.doc[w]]
        # of each window, the first place and the first in another document
        order = np.argsort(hashes, kind="stable")
        h, d = hashes[order], doc[order]
        start = np.r_[True, h[1:] != h[:-1]][: len(h)]
        other = np.r_[True, d[1:] != d[:-1]][: len(h)] & ~start
        nth = np.cumsum(other)
        nth -= np.maximum.accumulate(np.where(start, nth, 0))
        keep = np.sort(order[start | (other & (nth == 1))])
        w, hashes, doc = w[keep], hashes[keep], doc[keep]
        at = w - held.base[words.doc[w]]
        # by their own hash, so that a minimizer with many different windows isn't one group
        group = hashes % part_of
        return _sliced(group, table.column("bucket")[0].as_py(), {"hashes": hashes, "checks": words.checks(k, w), "docs": doc, "at": at}, second)

    def sources(table: pa.Table) -> pa.Table:
        hashes, counts = _numbers(table.column("hashes"), "<u8")
        checks, docs_, at = _numbers(table.column("checks"), "<u4")[0], _numbers(table.column("docs"))[0], _numbers(table.column("at"))[0]
        bucket = np.repeat(table.column("bucket").to_numpy(), counts)
        order = np.lexsort((at, docs_, checks, hashes))
        h, c, d = hashes[order], checks[order], docs_[order]
        start = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])][: len(h)]
        head = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
        # one answer for each bucket that holds the window in another document than its source
        later = np.flatnonzero(d != d[head])
        rows, source = order[later], order[head[later]]
        # by bucket and place, so that differences are small
        back = np.lexsort((at[rows], docs_[rows], bucket[rows]))
        rows, source = rows[back], source[back]
        return _sliced(bucket[rows], table.column("part")[0].as_py(), {"docs": docs_[rows], "at": at[rows], "source_docs": docs_[source], "source_at": at[source]}, answer, by="bucket")

    def strings(table: pa.Table) -> pa.Table:
        """A bucket's edges, those that follow each other in their document and in their source as one string."""
        doc, at, source_doc, source_at = (_numbers(table.column(c))[0] for c in ("docs", "at", "source_docs", "source_at"))
        order = np.lexsort((at, doc))
        doc, at, source_doc, source_at = doc[order], at[order], source_doc[order], source_at[order]
        heads, start, end = compact(at, doc, source_doc, source_at, 0)
        columns = [np.full(len(heads), table.column("bucket")[0].as_py()), doc[heads], start, end - start + 1, source_doc[heads], source_at[heads]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, string, strict=True)], schema=string)

    def speak(table: pa.Table, asked: pa.Table) -> pa.Table:
        """The words of every path that is asked for, from its source document: those on which its edges begin, or where n is 0 the next k - 1."""
        if not table.num_rows or not asked.num_rows:
            return spoken.empty_table()
        own = table.filter(pc.is_in(table.column("doc_id"), pc.unique(asked.column("source_doc")))).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        by: dict[int, list[bytes]] = {}
        for doc, text in zip(own.column("doc_id").to_pylist(), _texts(own), strict=True):
            by.setdefault(doc, []).extend(text.split())
        rows = asked.select(["source_doc", "source_start", "n"])
        said = [b" ".join(by[doc][at : at + (n or k - 1)]) for doc, at, n in zip(*(c.to_pylist() for c in rows.columns), strict=True)]
        return rows.append_column("words", pa.array(said, pa.binary())).cast(spoken)

    out_fields = [("doc_id", pa.int64(), "long"), ("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    out_fields += [("kept", pa.string(), "string")] * text_out
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source_doc", pa.int64()), ("source_start", pa.int64())]))
    out_fields += [("spans", span_type, "array<struct<start:long,end:long,source_doc:long,source_start:long>>")] * spans

    def removed(table: pa.Table, replies: pa.Table) -> pa.Table:
        held = Bucket(table)
        table, texts, ids, words = held.table, held.texts, held.ids, held.words
        gone = np.zeros(len(words.hash) + 1, np.int64)
        w = source_doc = source_at = np.zeros(0, np.int64)
        if replies.num_rows:
            # by document and place: after a path come those that go on with its string, and its end
            replies = replies.sort_by([("doc", "ascending"), ("start", "ascending"), ("n", "ascending")])
            start, n, path_start = (replies.column(c).to_numpy().astype(np.int64) for c in ("start", "n", "source_start"))
            spoken_words = np.where(n > 0, n, k - 1)
            place_of = np.cumsum(spoken_words) - spoken_words
            first_word = words.first[np.searchsorted(ids, replies.column("doc").to_numpy())] + start
            path = np.repeat(np.arange(len(n)), n)
            along = np.arange(len(path)) - np.repeat(np.cumsum(n) - n, n)
            runs = words.runs(k)
            key, index = np.unique(runs[first_word[path] + along], return_index=True)
            path, along = path[index], along[index]
            w = words.windows(k)
            at = np.minimum(np.searchsorted(key, runs[w]), len(key) - 1)
            from_doc = replies.column("source_doc").to_numpy()
            hit = (key[at] == runs[w]) & (from_doc[path[at]] < ids[words.doc[w]])
            w, path, along = w[hit], path[at[hit]], along[at[hit]]
            ok = _confirmed(held, w, place_of[path] + along, b" ".join(replies.column("words").to_pylist()), k)
            w, path, along = w[ok], path[ok], along[ok]
            source_doc, source_at = from_doc[path], path_start[path] + along
        # the words of the paths go
        heads, starts, ends = compact(w, words.doc[w], source_doc, source_at, k)
        np.add.at(gone, starts, 1)
        np.subtract.at(gone, ends, 1)
        gone = np.cumsum(gone[:-1]) > 0
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        data, total = words.data, np.r_[0, np.cumsum(gone)]
        for i, text in enumerate(texts):
            a, b = words.first[i], words.first[i + 1]
            n = int(total[b] - total[a])
            parts_ = text.split() if not n else [data[s:e] for s, e in zip(words.starts[a:b][~gone[a:b]].tolist(), words.ends[a:b][~gone[a:b]].tolist(), strict=True)]
            kept = b" ".join(parts_)
            out["n_words"].append(b - a)
            out["n_removed"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if text_out:
                out["kept"].append((kept if n else text).decode())
        out["doc_id"] = table.column("doc_id").combine_chunks()
        if spans:
            found: list[list[dict]] = [[] for _ in texts]
            for x, start, end in zip(heads.tolist(), starts.tolist(), ends.tolist(), strict=True):
                i = int(words.doc[start])
                found[i].append({"start": int(start - words.first[i]), "end": int(end - words.first[i]), "source_doc": int(source_doc[x]), "source_start": int(source_at[x])})
            out["spans"] = found
        made = [pa.array(out[n], t) for n, t, _ in out_fields]
        return pa.Table.from_arrays([*made, *([table.column("row")] if row else [])], names=[n for n, _, _ in out_fields] + ["row"] * row)

    ddl = lambda s: ", ".join(f"{f.name} {dict(int64='long', int32='int', binary='binary')[str(f.type)]}" for f in s)
    met = by_bucket.applyInArrow(minimizers, ddl(first)).groupBy("part").applyInArrow(repeated, ddl(first))
    windows = by_bucket.cogroup(met.groupBy("bucket")).applyInArrow(candidates, ddl(second))
    paths = compact_paths(windows.groupBy("part").applyInArrow(sources, ddl(answer)).groupBy("bucket").applyInArrow(strings, ddl(string)))
    asked = paths.select("source_doc", "source_start", "n").distinct().withColumn("bucket", bucket_of("source_doc").cast("int"))
    words_at = by_bucket.cogroup(asked.groupBy("bucket")).applyInArrow(speak, ddl(spoken))
    told = paths.join(words_at, ["source_doc", "source_start", "n"])
    result = T._parse_datatype_string(", ".join(f"{n} {t}" for n, _, t in out_fields))
    return by_bucket.cogroup(told.groupBy("bucket")).applyInArrow(removed, result.add("row", kept_in.schema["row"].dataType) if row else result)
