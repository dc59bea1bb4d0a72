"""Token-id output: best-fit-decreasing packing into rows of fixed width, as little-endian binary matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bestfit import cut
from .common import long_texts, slices, texts_of
from .tokens import encoder

#: Tokens that a task gathers before it packs them: a shard.
SHARD = 4 << 20

SCHEMA = "shard long, row int, ids binary, cu_seqlens array<int>, position_ids binary, n_tokens int, doc_ids array<long>, starts array<long>"


class RoomTree:
    """A segment tree over the free capacities 0..capacity: how many open rows have each, and the least that fits."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int:
        """The smallest room of at least need that an open row has, or -1."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:  # up to the first right sibling that holds rows, then down its left edge
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Rows of piece numbers: pieces from long to short (ties in their order), each to the open row with least room for it."""
    tree, open_rows, rows = RoomTree(width), [[] for _ in range(width + 1)], []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        room = tree.least(n)
        if room < 0:
            rows.append([])
            row, room = len(rows) - 1, width
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(piece)
        if room > n:
            open_rows[room - n].append(row)
            tree.add(room - n, 1)
    return rows


def packed_rows(docs: DataFrame, tokenizer: str, width: int = 1024, end_id: int = 50256, pad_id: int = 0, dtype: str = "<u2", shard_tokens: int = SHARD) -> DataFrame:
    """Encode whole texts, add end_id, cut what is longer than width without loss, and pack into rows of width tokens.

    One row per packed sequence: shard, row (within the shard), ids (width ids of dtype, padded with pad_id),
    cu_seqlens (cumulative lengths of the pieces, from 0; the last is n_tokens), position_ids (positions of dtype that
    start again from 0 with each piece; 0 in padding), n_tokens, and for each piece its doc_id and start in its
    document. A document's pieces may lie in different rows of its shard, so it can be put together again.

    A task packs what it scans, in shards of about shard_tokens tokens (never less than one document), so nothing is
    shuffled and a task holds one shard at most. A shard fills its rows but for one or two, so shards cost a share of
    about width / shard_tokens. Null text is empty and gives one piece, end_id. Repeated rows are packed each. An
    empty table gives no rows. Extra columns are ignored. Ids that dtype can't hold raise an error.
    """
    schema = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
    kind = np.dtype(dtype)
    if width > np.iinfo(kind).max + 1 or end_id > np.iinfo(kind).max or pad_id > np.iinfo(kind).max:
        raise ValueError(f"{dtype} can't hold the ids or positions")

    def rows_of(held: list[tuple[int, np.ndarray]], shard: int) -> Iterator[pa.RecordBatch]:
        pieces = [(doc, s, ids[s : s + n]) for doc, ids in held for s, n in cut(len(ids), width)]
        rows = best_fit_decreasing(np.array([len(x) for _, _, x in pieces]), width)
        steps = np.arange(width, dtype=kind)
        for at in range(0, len(rows), 1024):
            out: list[list] = [[] for _ in schema]
            for r, row in enumerate(rows[at : at + 1024], at):
                sizes = [len(pieces[p][2]) for p in row]
                ends = np.cumsum([0, *sizes])
                ids, places = np.full(width, pad_id, kind), np.zeros(width, kind)
                for p, s, e in zip(row, ends, ends[1:], strict=False):
                    ids[s:e], places[s:e] = pieces[p][2], steps[: e - s]
                for column, value in zip(out, (shard, r, ids.tobytes(), ends, places.tobytes(), int(ends[-1]), [pieces[p][0] for p in row], [pieces[p][1] for p in row]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, context = encoder(tokenizer), TaskContext.get()
        if len(enc.lengths) > np.iinfo(kind).max + 1:
            raise ValueError(f"{dtype} can't hold the tokenizer's ids")
        shard = (context.partitionId() if context else 0) << 32
        held: list[tuple[int, np.ndarray]] = []
        tokens = 0
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = np.append(np.frombuffer(enc.ids(text), "<u4").astype(kind), kind.type(end_id))
                if held and tokens + len(ids) > shard_tokens:
                    yield from rows_of(held, shard)
                    shard, held, tokens = shard + 1, [], 0
                held.append((doc, ids))
                tokens += len(ids)
        if held:
            yield from rows_of(held, shard)

    return long_texts(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """(doc_id, start, ids) of every piece in packed_rows(); a document is its pieces by start."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, starts, ids = [], [], []
            for row, ends, d, s in zip(*(b.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "starts")), strict=True):
                flat = np.frombuffer(row, dtype).astype(np.int32)
                docs += d
                starts += s
                ids += [flat[x:y] for x, y in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return packed.mapInArrow(run, "doc_id long, start long, ids array<int>")


def write_rows(packed: DataFrame, path: str) -> None:
    """Write the matrices as Parquet; binary cells are little-endian rows that numpy.frombuffer reads."""
    packed.write.parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
