"""Removal of lines that several documents hold, by sharded minimal perfect hashes over the distinct lines.

A line's key is its text without white space at both ends, A-Z lower-cased; its digest has 128 bits. Batches of documents
send each digest once, with the smallest and greatest document and a count, and Spark adds these up. The distinct
digests go to shards by their hash, and every shard becomes one row: a minimal perfect hash (bit vectors in levels: a
digest that is alone on its bit of a level has its number there, the others go on to the next level), and arrays in the
order of these numbers: 32-bit fingerprints, counts in as few bytes as the greatest needs, and the smallest document of
each line that comes in two or more.

Documents are dealt once into buckets of a few megabytes. A bucket asks each shard with the digests of its lines, each
once however often it holds them. A shard's row comes first in its stream and is held, questions pass by it one after
another, so that a line that all documents hold takes no more memory than any other. Answers go back to buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import long_texts, materialize, run_bounds, slices, texts_of

#: Bytes of text in a bucket of documents, and digests in a shard, about.
BUCKET_BYTES, SHARD_LINES = 2 << 20, 200_000
#: Code points from which a line counts, the white space that is cut off, and bits of a level for each digest.
LEAST, SPACE, ROOM = 10, " \t\n\x0b\x0c\r", 1.6

_DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

INDEX_SCHEMA = "shard int, n int, sizes array<int>, bits binary, prints binary, width int, counts binary, firsts binary"


def key_digests(lines: list[str], least: int = LEAST) -> list[bytes | None]:
    """The digest of each line's key; None for keys of fewer than `least` code points."""
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE)
        out.append(xxh3_128_digest(key.encode().lower()) if len(key) >= least else None)
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash: a number from 0 to n - 1 for each of n different digests."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        left, sizes, levels = digests, [], []
        while len(left):
            words = max(1, int(len(left) * ROOM) // 64 + 1)
            at = cls._places(left, len(sizes), words)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(words)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    @staticmethod
    def _places(digests: np.ndarray, level: int, words: int) -> np.ndarray:
        return (_spread(digests["a"] ^ _spread(digests["b"] + np.uint64(level * int(_A) & 0xFFFFFFFFFFFFFFFF))) % np.uint64(words * 64)).astype(np.int64)

    def numbers(self, digests: np.ndarray) -> np.ndarray:
        """The number of each digest; for digests that weren't hashed any number, or -1."""
        out, open_, offset = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
        for level, words in enumerate(self.sizes):
            if not len(open_):
                break
            at = self._places(digests[open_], level, words) + offset * 64
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_ = open_[~hit]
            offset += words
        return out


def shard_row(shard: int, digests: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> dict:
    """The row of a shard: its perfect hash and the arrays in the order of its numbers."""
    hashed = PerfectHash.of(digests)
    order = np.argsort(hashed.numbers(digests))
    counts = counts[order]
    width = np.min_scalar_type(int(counts.max(initial=0))).itemsize
    return {
        "shard": shard,
        "n": len(digests),
        "sizes": hashed.sizes,
        "bits": hashed.bits.tobytes(),
        "prints": digests["b"][order].astype("<u4").tobytes(),
        "width": width,
        "counts": counts.astype(f"<u{width}").tobytes(),
        "firsts": firsts[order][counts > 1].astype("<i8").tobytes(),
    }


class Shard:
    """A shard's arrays, as its row holds them."""

    def __init__(self, row: dict) -> None:
        self.hashed = PerfectHash(row["sizes"], np.frombuffer(row["bits"], "<u8"))
        self.prints = np.frombuffer(row["prints"], "<u4")
        self.counts = np.frombuffer(row["counts"], f"<u{row['width']}")
        self.firsts = np.frombuffer(row["firsts"], "<i8")
        self.among = np.cumsum(self.counts > 1) - 1

    def repeated(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which digests are lines of two or more documents, and the smallest document of each of these."""
        number = self.hashed.numbers(digests)
        known = np.flatnonzero(number >= 0)
        number = number[known]
        hit = (self.prints[number] == digests["b"][known].astype("<u4")) & (self.counts[number] > 1)
        return known[hit], self.firsts[self.among[number[hit]]]


def line_counts(docs: DataFrame, column: str = "text", least: int = LEAST) -> DataFrame:
    """(a, b, first, n): the digest of each distinct key, the smallest document that holds it, and the number of rows that do (1 if all of them share one id)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for part in slices(iter([batch])):
                for doc, text in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), texts_of(part, column), strict=True):
                    if doc is None:
                        continue
                    for d in set(key_digests(text.split("\n"), least)):
                        if d is None:
                            continue
                        if was := seen.get(d):
                            was[0], was[1], was[2] = min(was[0], doc), max(was[1], doc), was[2] + 1
                        else:
                            seen[d] = [doc, doc, 1]
            digests = np.frombuffer(b"".join(seen), _DIGEST)
            rest = np.array(list(seen.values()), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(digests["a"].view("<i8")), pa.array(digests["b"].view("<i8")), *(pa.array(rest[:, i]) for i in range(3))], schema=schema)

    sent = long_texts(docs).select("doc_id", column).mapInArrow(work, "a long, b long, first long, last long, n long")
    first, last = F.min("first"), F.max("last")
    return sent.groupBy("a", "b").agg(first.alias("first"), F.when(first < last, F.sum("n")).otherwise(F.lit(1)).alias("n"))


def line_index(docs: DataFrame, column: str = "text", least: int = LEAST) -> DataFrame:
    """The index over all lines of docs, one row for each shard (INDEX_SCHEMA); written to the shared folder."""
    counts = materialize(line_counts(docs, column, least), "lines")
    shards = max(1, -(-counts.count() // SHARD_LINES))
    schema = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("prints", pa.binary()), ("width", pa.int32()), ("counts", pa.binary()), ("firsts", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        digests = np.empty(table.num_rows, _DIGEST)
        digests["a"], digests["b"] = (table.column(c).to_numpy().view("<u8") for c in "ab")
        row = shard_row(table.column("shard")[0].as_py(), digests, table.column("n").to_numpy(), table.column("first").to_numpy())
        return pa.Table.from_pylist([row], schema=schema)

    return materialize(counts.withColumn("shard", F.pmod("b", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, INDEX_SCHEMA), "line-index")


def drop_repeated_lines(docs: DataFrame, column: str = "text", least: int = LEAST, index: DataFrame | None = None, text_out: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, and with text_out `kept`): texts without lines that a document with a smaller id holds, too.

    Keys of at least `least` code points that two documents or more hold lose all their lines outside the smallest one,
    where all of them stay. The other lines stay as they are, joined by line feeds. index: a stored line_index (of these
    documents or more of them); else it is made. Null and empty texts are one empty line. Rows with equal doc_id are one
    document; rows without doc_id neither judge nor lose lines; an empty table gives no rows; other columns are ignored.
    Equal 128-bit digests count as equal keys. Of lines that an index of other documents doesn't hold, one in 2^32 may be
    taken for one that it does.
    """
    held = index if index is not None else line_index(docs, column, least)
    shards = held.count()
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(column))), F.lit(buckets)).cast("int")
    dealt = long_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text"), bucket.alias("bucket")).repartition("bucket")

    asked = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("digests", pa.binary())])
    answer = pa.schema([("bucket", pa.int32()), ("digests", pa.binary()), ("firsts", pa.binary())])
    result = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if text_out else [])])

    def ask(table: pa.Table) -> pa.Table:
        seen: set[bytes | None] = set()
        for batch in slices(iter(table.combine_chunks().to_batches())):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if doc is not None:
                    seen.update(key_digests(text.split("\n"), least))
        seen.discard(None)
        digests = np.frombuffer(b"".join(seen), _DIGEST)
        shard = (digests["b"].view("<i8") % np.int64(max(shards, 1))).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cuts, shard, digests = run_bounds(shard[order]), shard[order], digests[order]
        parts = [digests[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(shard[cuts[:-1]], pa.int32()), pa.array([table.column("bucket")[0].as_py()] * len(parts), pa.int32()), pa.array(parts, pa.binary())], schema=asked)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["bucket"] is None:
                    shard = Shard(row)
                    continue
                digests = np.frombuffer(row["digests"], _DIGEST)
                which, firsts = shard.repeated(digests)
                if len(which):
                    yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), pa.array([digests[which].tobytes()], pa.binary()), pa.array([firsts.tobytes()], pa.binary())], schema=answer)

    def clean(table: pa.Table, replies: pa.Table) -> pa.Table:
        firsts: dict[bytes, int] = {}
        for digests, first in zip(replies.column("digests").to_pylist(), replies.column("firsts").to_pylist(), strict=True):
            firsts |= zip((digests[i : i + 16] for i in range(0, len(digests), 16)), np.frombuffer(first, "<i8").tolist(), strict=True)
        rows: list[tuple] = []
        for batch in slices(iter(table.combine_chunks().to_batches())):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                lines = text.split("\n")
                kept = lines if doc is None or not firsts else [line for line, d in zip(lines, key_digests(lines, least), strict=True) if d is None or firsts.get(d, doc) == doc]
                whole = "\n".join(kept)
                rows.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(whole.encode()).hexdigest(), whole)[: len(result)])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(result), result, strict=True)], schema=result)

    questions = dealt.groupBy("bucket").applyInArrow(ask, "shard int, bucket int, digests binary")
    stream = held.unionByName(questions, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("bucket").asc_nulls_first())
    answers = stream.mapInArrow(probe, "bucket int, digests binary, firsts binary")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if text_out else "")
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(clean, schema)
