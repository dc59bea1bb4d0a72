"""Bulk-synchronous best-fit packing of documents into token sequences of one length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import long_texts, materialize, slices, texts_of
from .tokens import encoder

#: Pieces in one rank bucket, about.
BUCKET = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all hold capacity tokens but the first, which may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: ids of its whole text, then end_id, cut only if longer than capacity.

    Columns doc_id, piece, start, length, ids_crc32, and ids (array<int>) if with_ids. A null text counts as empty, so
    every document has one piece at least. Repeated rows give repeated pieces; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = enc.ids(text) + tail
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * s : 4 * (s + n)]
                    out.append((doc, k, s, n, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return long_texts(docs).select("doc_id", "text").mapInArrow(run, _PIECES + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit-decreasing over size classes: (segments, number of sequences).

    counts: pieces of each size, so at most `capacity` entries however many documents there are. Sizes are taken in
    descending order; each is matched with the smallest gap it fits (the successor in the sorted gaps), as often as
    that gap holds it, and new sequences are opened when no gap is left. All pieces of a size and all gaps of a size
    are matched in one bulk step: the r-th piece takes the r-th gap, so ranks settle conflicts. A segment is
    (size, first rank, ranks, first sequence, pieces in each sequence, offset of the first of them).
    """
    gaps: dict[int, list[list[int]]] = {}  # remaining capacity -> [first sequence, how many]
    order: list[int] = []  # the capacities in gaps, sorted
    segments: list[tuple[int, ...]] = []
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in gaps:
                gaps[room] = []
                insort(order, room)
            if gaps[room] and gaps[room][-1][0] + gaps[room][-1][1] == first:
                gaps[room][-1][1] += n
            else:
                gaps[room].append([first, n])

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0

        def put(first: int, room: int, each: int, sequences: int, size: int = size) -> None:
            nonlocal left, rank
            if sequences:
                segments.append((size, rank, each * sequences, first, each, capacity - room))
                left -= each * sequences
                rank += each * sequences
                leave(room - each * size, first, sequences)

        while left:
            i = bisect_left(order, size)
            room = order[i] if i < len(order) else capacity
            each = room // size
            if i < len(order):
                first, n = gaps[room].pop(0)
                if not gaps[room]:
                    del gaps[room], order[i]
            else:
                first, n = opened, -(-left // each)
                opened += n
            full = min(n, left // each)
            put(first, room, each, full)
            if left and full < n:
                put(first + full, room, left, 1)
                full += 1
            if full < n:
                leave(room, first + full, n - full)
    return np.array(segments, np.int64).reshape(-1, 6), opened


def pack(pieces: DataFrame, capacity: int = 1024, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of 1 to capacity: as few sequences as best-fit-decreasing needs.

    Each step is one bulk-synchronous round over sorted classes: equal lengths form a class, equal gaps form a class,
    and the rounds work on the class table, which has `capacity` rows at most and so a fixed size; the rows themselves
    stay in Spark and only learn their rank within their length. Ranks come from counts by (bucket, length) summed up
    over the buckets, so no task sees all rows of a length. Ties are placed in the order of hash bucket and key;
    repeated rows are packed each; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    buckets = max(1, -(-n // BUCKET))
    held = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    by = held.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = by.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    counts = {int(r[0]): int(r[1]) for r in held.groupBy("length").agg(F.count("*")).collect()}  # capacity rows at most
    segments, _ = plan(counts, capacity)
    ranked = held.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_bucket")
    shift = max(counts.values(), default=1).bit_length()
    starts = (segments[:, 0] << shift) + segments[:, 1]
    order = np.argsort(starts)
    shared = spark.sparkContext.broadcast((starts[order], segments[order]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, segments = shared.value
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            s = segments[np.searchsorted(starts, (size << shift) + rank, "right") - 1] if len(size) else np.zeros((0, 6), np.int64)
            at = rank - s[:, 1]
            each = np.maximum(s[:, 4], 1)
            kept = [(f.name, batch.column(f.name)) for f in batch.schema if f.name != "_rank"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(s[:, 3] + at // each), pa.array(s[:, 5] + at % each * size)], names=[k for k, _ in kept] + ["sequence_id", "offset"])

    fields = [f for f in ranked.schema if f.name != "_rank"]
    return ranked.mapInArrow(place, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack all documents; one row per piece with its place.

    Null text is empty (one piece that holds end_id alone); an empty table gives no rows; rows that repeat are packed
    each; extra columns are dropped. The pieces are written to the shared folder once, so nothing is encoded twice.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids), "sequence_id", "offset"]
    return pack(pieces, capacity).select(*cols)
