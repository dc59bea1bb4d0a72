"""Approximate nearest neighbours by a forest of random-projection trees with one priority queue over all of them."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import complete_runs, materialize, run_bounds
from .rabitq import is_valid, rotation

#: Rows that the forest is fitted on at most; rows in a leaf, about; the least and greatest depth of a tree; index rows in a shard.
FIT_ROWS, LEAF, LEAST_DEPTH, DEPTH, SHARD = 16_384, 2048, 4, 12, 8192
#: Results that a task holds before it sends them on.
HELD = 1 << 20
#: Fitted rows by which a search tells what share of the index its leaves hold.
PILOT = 2048


class Forest:
    """Trees of halving cuts: tree t cuts level l along column l of its own random rotation, at each node's median of the fitted rows.

    Of size trees * 2**depth * (8 + PILOT / 8) bytes, which FIT_ROWS and DEPTH bound.
    """

    def __init__(self, fit: np.ndarray, trees: int, depth: int, seed: int = 11) -> None:
        self.trees, self.depth, self.dim, self.seed = trees, depth, fit.shape[1], seed
        self.cuts: list[list[np.ndarray]] = []
        self.held: list[np.ndarray] = []
        for t in range(trees):
            along, node, levels = self.project(fit, t), np.zeros(len(fit), np.int64), []
            for level in range(depth):
                cut = np.zeros(1 << level)
                for k in range(1 << level):
                    here = along[node == k, level]
                    cut[k] = np.median(here) if len(here) else 0
                levels.append(cut)
                node = 2 * node + (along[:, level] > cut[node])
            self.cuts.append(levels)
            pilot = np.zeros((1 << depth, min(PILOT, len(fit))), bool)
            pilot[node[:PILOT], np.arange(pilot.shape[1])] = True
            self.held.append(np.packbits(pilot, axis=1))

    def project(self, x: np.ndarray, tree: int) -> np.ndarray:
        return x @ rotation(self.dim, tree, self.seed)[:, : self.depth]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            along, node = self.project(x, t), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + (along[:, level] > self.cuts[t][level][node])
            out[:, t] = node
        return out

    def search(self, x: np.ndarray, share: float, least: int) -> Iterator[list[tuple[int, int]]]:
        """For each row, the (tree, leaf) in order of nearness until they hold `share` of the pilot rows, and `least` of them.

        One queue holds the nodes of all trees, by the squared distance of the row from their cell, summed over the
        cuts between (columns of a rotation are at right angles).
        """
        rows = sum(int(np.bitwise_count(row).sum()) for row in self.held[0])
        need = max(share * rows, min(rows, least))
        all_along = [self.project(x, t) for t in range(self.trees)]
        for i in range(len(x)):
            queue = [(0.0, t, 0, 0) for t in range(self.trees)]
            seen = np.zeros(self.held[0].shape[1], np.uint8)
            visits = []
            while queue:
                far, t, level, node = heapq.heappop(queue)
                along, cuts = all_along[t][i], self.cuts[t]
                while level < self.depth:
                    gap = along[level] - cuts[level][node]
                    side = int(gap > 0)
                    level += 1
                    heapq.heappush(queue, (far + gap * gap, t, level, 2 * node + 1 - side))
                    node = 2 * node + side
                visits.append((t, node))
                seen |= self.held[t][node]
                if np.bitwise_count(seen).sum() >= need:
                    break
            yield visits


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, trees: int = 8, share: float = 0.85, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of df, but its own, with the largest inner product.

    The forest is fitted on FIT_ROWS rows of df at most (drawn by hash) and broadcast, its size being bounded;
    every row of df is indexed in a leaf of each tree, every query goes to leaves that hold `share` of the rows
    together (and 4 k of them at least), and within the shards of leaves the candidates are ranked by exact inner products in double precision.
    A task sends a query's best over all the shards it holds, not over each.
    Shards hold about SHARD rows whatever the size of df: leaves are gathered to that, and shards that hold more, as
    where vectors crowd, are salted by their own counts. Of equal vectors the k + 1 with the smallest ids are indexed:
    no others can be among a query's k. Tables of any size are
    searched by the forest, of LEAST_DEPTH levels or more. Longer vectors reach beyond their cell, so where lengths vary greatly raise `share`.

    Ties go to the smaller vec_id; rows that repeat a vec_id count once for each vector, and rows with the query's own
    id are left out. Rows without a vec_id and rows whose vector is null, empty, zero or holds null or non-finite components take no part, nor do
    vectors of another length than most of the fitted ones. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(is_valid("v") & F.col("vec_id").isNotNull())
    asked = queries.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(is_valid("v") & F.col("vec_id").isNotNull())
    # of equal vectors only the k + 1 smallest ids can be among a query's k; the limit on the rank is applied before the shuffle
    rows = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("_r") <= k + 1).select("vec_id", "v")
    rows = materialize(rows, "vectors")
    n = rows.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30))
    drawn = rows.filter(draw < int(min(1.0, 1.2 * FIT_ROWS / max(n, 1)) * (1 << 30))).select(draw.alias("draw"), "vec_id", "v").limit(2 * FIT_ROWS).toArrow()
    fit = drawn.sort_by([("draw", "ascending"), ("vec_id", "ascending")]).column("v").slice(0, FIT_ROWS).to_pylist()
    sizes = np.array([len(v) for v in fit], int)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 1
    sample = np.array([v for v in fit if len(v) == dim], float).reshape(-1, dim)
    depth = min(DEPTH, dim, max(LEAST_DEPTH, math.ceil(math.log2(max(n, 1) / LEAF))))
    if len(sample) == 0:
        sample = np.zeros((1, dim))
    forest = spark.sparkContext.broadcast(Forest(sample, trees, depth))
    leaf_rows = max(1, n >> depth)
    wide = max(0, int(math.log2(max(1, SHARD // leaf_rows))))  # leaves in a shard, as a power of two

    kind = np.dtype("<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8")

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        v = batch.column("v")
        part = batch.filter(pa.array(np.diff(v.offsets.to_numpy()) == dim))
        return part.column("vec_id").to_numpy(), part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        sums = np.zeros((f.trees, (1 << f.depth) >> wide or 1), np.int64)
        for batch in batches:
            shards = f.leaves(columns(batch)[1]) >> wide
            for t in range(f.trees):
                sums[t] += np.bincount(shards[:, t], minlength=sums.shape[1])
        t, shard = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(shard), pa.array(sums[t, shard])], names=["tree", "shard", "n"])

    # a row for each shard of each tree, trees * 2 ** DEPTH at most: how many tasks it is dealt to
    counted = rows.mapInArrow(count, "tree long, shard long, n long").groupBy("tree", "shard").agg(F.sum("n").alias("n")).toArrow()
    salts = np.ones((trees, (1 << depth) >> wide or 1), np.int64)
    salts[counted.column("tree").to_numpy(), counted.column("shard").to_numpy()] = -(-counted.column("n").to_numpy() // SHARD)

    def as_rows(tree, shard, salt, asks, ids, leaves, x) -> pa.RecordBatch:
        task = (np.asarray(tree, np.int64) << 44) + (np.asarray(shard, np.int64) << 24) + np.asarray(salt, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.full(len(task), asks)), pa.array(ids, pa.int64()), pa.array(leaves, pa.binary()), pa.array([r.astype(kind).tobytes() for r in x], pa.binary())], names=["task", "asks", "id", "leaves", "x"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            ids, x = columns(batch)
            leaves = f.leaves(x).astype("<i4")
            for t in range(f.trees):
                shard = leaves[:, t] >> wide
                yield as_rows(np.full(len(ids), t), shard, ids % salts[t][shard], False, ids, [leaf.tobytes() for leaf in leaves[:, t]], x)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            ids, x = columns(batch)
            for at in range(0, len(ids), 1000):
                out: list[tuple] = []
                for i, visits in enumerate(f.search(x[at : at + 1000], share, 4 * k), at):
                    by: dict[tuple[int, int], list[int]] = {}
                    for t, leaf in visits:
                        by.setdefault((t, leaf >> wide), []).append(leaf)
                    out += [(t, s, salt, ids[i], np.array(own, "<i4").tobytes(), x[i]) for (t, s), own in by.items() for salt in range(salts[t][s])]
                tree, shard, salt, own_ids, leaves, own = (list(c) for c in zip(*out, strict=True))
                yield as_rows(tree, shard, salt, True, own_ids, leaves, own)

    def ranked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score): of one shard the k best of each query that comes to it."""
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        all_ids, blobs = group.column("id").to_numpy(), group.column("leaves").to_pylist()
        all_x = np.frombuffer(b"".join(group.column("x").to_pylist()), kind).reshape(-1, dim).astype(float)
        ids, x = all_ids[~asks], all_x[~asks]
        leaf = np.frombuffer(b"".join(b for b, q in zip(blobs, asks, strict=True) if not q), "<i4")
        # of equal vectors in a leaf only the k + 1 smallest ids can be among a query's k
        _, same = np.unique(x.view(np.dtype((np.void, x.itemsize * dim))).ravel(), return_inverse=True)
        order = np.lexsort((ids, same, leaf))
        # rows that repeat count once, so they take no others' places
        order = order[np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(same[order]) != 0) | (np.diff(leaf[order]) != 0)][: len(order)]]
        head = np.r_[True, (np.diff(same[order]) != 0) | (np.diff(leaf[order]) != 0)][: len(order)]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) if len(order) else order
        order = order[place <= k]
        ids, x, leaf = ids[order], x[order], leaf[order]
        q_ids, q = all_ids[asks], all_x[asks]
        visits = [np.frombuffer(b, "<i4") for b, own in zip(blobs, asks, strict=True) if own]
        of, where = np.repeat(np.arange(len(visits)), [len(v) for v in visits]), np.concatenate([np.zeros(0, "<i4"), *visits])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for one in np.unique(where):
            a, b = np.searchsorted(leaf, [one, one + 1])
            askers = of[where == one]
            for at in range(0, len(askers) if a < b else 0, 1024):
                own = askers[at : at + 1024]
                scores = q[own] @ x[a:b].T
                scores[q_ids[own][:, None] == ids[None, a:b]] = -np.inf
                near = scores > -np.inf
                if b - a > k:  # with what may have been rounded below the k-th
                    edge = np.partition(scores, b - a - k, axis=1)[:, b - a - k]
                    near &= scores >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None]
                r, c = np.nonzero(near)
                out.append((q_ids[own[r]], ids[a + c], (q[own[r]] * x[a + c]).sum(axis=1)))
        return best(*(np.concatenate([o[i] for o in out]) for i in range(3)))

    def best(q: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query, each candidate and score once; ties by id."""
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        fresh = np.r_[True, (np.diff(q) != 0) | (np.diff(c) != 0) | (np.diff(s) != 0)][: len(q)]
        q, c, s = q[fresh], c[fresh], s[fresh]
        start = np.flatnonzero(np.r_[True, np.diff(q) != 0][: len(q)])
        keep = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k
        return q[keep], c[keep], s[keep]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query over the shards of a task, gathered up to HELD rows at a time."""
        names = ["query_id", "vec_id", "score"]
        held, n_held = [], 0
        for table in complete_runs(batches, "task"):
            cuts = run_bounds(table.column("task").to_numpy())
            for s, e in zip(cuts, cuts[1:], strict=False):
                held.append(ranked(table.slice(s, e - s)))
                n_held += len(held[-1][0])
            if n_held > HELD:
                held = [best(*(np.concatenate([h[i] for h in held]) for i in range(3)))]
                n_held = len(held[0][0])
                if n_held > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=names)
                    held, n_held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best(*(np.concatenate([h[i] for h in held]) for i in range(3)))], names=names)

    schema = "task long, asks boolean, id long, leaves binary, x binary"
    met = rows.mapInArrow(index, schema).unionByName(asked.mapInArrow(probe, schema)).repartition("task").sortWithinPartitions("task", "asks")
    found = met.mapInArrow(rank, "query_id long, vec_id long, score double").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
