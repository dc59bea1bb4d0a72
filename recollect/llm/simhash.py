"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees over shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import complete_runs, forest_edges, long_texts, materialize, run_bounds, slices, texts_of
from .components import components

#: Fingerprints in a tree, shingles hashed at once, and members from which a shard is dealt out further.
TREE, STEP, LARGE = 8192, 1 << 16, 4096
#: Fingerprints of more than FEW rows, and more than one in SHARE of all, are joined by broadcast.
FEW, SHARE = 100, 2000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: The bits of a byte as eight counters of a byte each, and the most that such a counter holds.
_COUNTERS, MOST = _BITS.astype(np.uint8).view(np.uint64).ravel(), 255


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text: a bit is set if over half of the shingle hashes have it. No words: zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(data, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(starts), STEP):
        a, b = starts[at : at + STEP], ends[at : at + STEP]
        h = np.fromiter(map(xxh64_intdigest, map(data.__getitem__, map(slice, a, b)), repeat(seed)), np.uint64, len(a)).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[j] += np.bincount(h[:, j], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(counts * 2 > len(starts), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed long; null text counts as empty. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t.encode(), shingle, seed) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps)], schema=schema)

    return long_texts(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers dealt anew, one to one: every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprints(sets: list[np.ndarray], bits: int, seed: int = 42) -> np.ndarray:
    """The SimHash, of `bits` bits in words of 64, of each set of different 64-bit shingle hashes; sets mustn't be empty.

    Each word has hashes of its own, mixed from the given ones. A bit is set if over half of the set's hashes have it.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    # counters of a byte: a set is added up in pieces
    pieces = -(-sizes // MOST)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + MOST * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    out = np.empty((len(sets), bits // 8), np.uint8)
    for at in range(0, bits // 8, 8):
        step = (0x9E3779B97F4A7C15 * (seed + at // 8 + 1)) & 0xFFFFFFFFFFFFFFFF
        h = mixed(flat + np.uint64(step)).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts = np.add.reduceat(_COUNTERS[h[:, j]], cuts).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
            out[:, at + j] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)


class BkTree:
    """A BK-tree of 64-bit numbers: a child hangs at its Hamming distance to its parent."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.child = np.full((len(values), 65), -1, np.int32)
        plain, child = values.tolist(), self.child
        for i in range(1, len(plain)):
            at = 0
            while True:
                d = (plain[i] ^ plain[at]).bit_count()
                if (below := child[at, d]) < 0:
                    child[at, d] = i
                    break
                at = below

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) numbers at most radius apart: all queries go down together, along the edges within the radius only."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int32)
        found = []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            found.append((q[near], node[near]))
            step = d[:, None] + np.arange(-radius, radius + 1)
            below = np.where((step >= 0) & (step <= 64), self.child[node[:, None], np.clip(step, 0, 64)], -1)
            row, column = np.nonzero(below >= 0)
            q, node = q[row], below[row, column]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _links(fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, in rep, of the links within one shard."""
    a, b = [], []
    for at in range(0, len(fp), TREE):
        tree = BkTree(fp[at : at + TREE])
        for q in range(at, len(fp), TREE):
            x, y = tree.within(fp[q : q + TREE], radius)
            x, y = x + q, y + at
            x, y = x[x > y], y[x > y]
            if len(x):
                x, y = forest_edges(rep[x], rep[y])
                a.append(x)
                b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that join all fingerprints at most radius bits apart, by their rep; fps: (fp, rep), fp distinct.

    The 64 bits are cut into radius + 2 blocks, so two fingerprints within the radius agree in two whole blocks at
    least: each pair of blocks, with its value, is a shard, and every such link lies within a shard. Each shard has a
    BK-tree of its own, made in the task that holds it; queries are dealt to the trees, for the trees of all documents
    together have no bound that would let them be broadcast. Of each tree's links a spanning forest is kept. Shards of
    more than LARGE members are dealt out once more, by radius + 1 blocks of the bits that they don't share.
    """
    if radius != 2:
        raise ValueError("the blocks are laid out for a radius of 2")
    piece = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = list(combinations(range(4), 2))
    keyed = fps.select("fp", "rep", F.explode(F.array(*(F.shiftleft(piece(i), 16).bitwiseOR(piece(j)).bitwiseOR(F.lit(n << 32)) for n, (i, j) in enumerate(pairs)))).alias("key"))
    large = materialize(keyed.groupBy("key").count().filter(F.col("count") > LARGE).select("key"), "shards")
    if large.count():  # few: each stands for over LARGE rows
        rest = F.lit(None).cast("long")
        for n, (i, j) in enumerate(pairs):
            k, m = sorted({0, 1, 2, 3} - {i, j})
            rest = F.when(F.shiftright("key", 32) == n, F.shiftleft(piece(k), 16).bitwiseOR(piece(m))).otherwise(rest)
        parts = F.array(*(F.xxhash64("key", F.lit(n), F.shiftright(rest, 11 * n).bitwiseAND(F.lit(0x7FF))) for n in range(3)))
        keyed = keyed.join(large.withColumn("large", F.lit(True)), "key", "left").withColumn("key", F.explode(F.when(F.col("large"), parts).otherwise(F.array("key")))).drop("large")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_runs(batches, "key"):
            key, fp, rep = (table.column(c).to_numpy() for c in ("key", "fp", "rep"))
            cuts = run_bounds(key)
            shared = np.flatnonzero(np.diff(cuts) > 1)
            found = [_links(fp[cuts[i] : cuts[i + 1]].view(np.uint64), rep[cuts[i] : cuts[i + 1]], radius) for i in shared]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[n] for x in found]), pa.int64()) for n in (0, 1)], schema=schema)

    return keyed.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row: documents whose fingerprints differ in radius bits or fewer are linked,
    and component_id is the smallest doc_id that links reach.

    Rows with equal fingerprints, such as texts without words (fingerprint 0), are one node, so copies cost nothing
    beyond their grouping; null text counts as empty; rows without a doc_id link by equal fingerprints only; repeated rows come
    back each; an empty table gives no rows; other columns are ignored. Fingerprints are written once to the shared
    folder. Fingerprints that more than 1 in SHARE of the rows have, so SHARE at most, are broadcast with their
    component; all others are joined back by fingerprint.
    """
    own = materialize(fingerprints(docs), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    joined = components(links(fps.filter("rep is not null").drop("n"), radius))
    classes = materialize(fps.join(joined, fps.rep == joined.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")), "classes")
    often = F.col("n") > max(FEW, own.count() // SHARE)
    hot = F.broadcast(classes.filter(often).select("fp", "component_id"))
    rest = own.join(hot.select("fp"), "fp", "left_anti").join(classes.filter(~often), "fp")
    return own.join(hot, "fp").select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))
