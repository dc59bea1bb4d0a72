"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import complete_runs, forest_edges, materialize, run_bounds
from .components import components

#: Vectors in a bucket, about (32 bits of key, 10 bits of table number and 20 of length are one long); rows of a bucket compared in one block; miss rate of a link at the threshold itself.
BUCKET, BLOCK, MISS = 256, 2048, 1e-3

_rotations: dict[tuple[int, int, int], np.ndarray] = {}


def is_valid(vector: str = "embedding") -> Column:
    """Whether a vector is there, not zero, and of finite components only."""
    fine = f"size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)"
    return F.coalesce(F.expr(fine), F.lit(False))


def rotation(dim: int, which: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if (dim, which, seed) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([seed, dim, which]).normal(size=(dim, dim)))
        _rotations[dim, which, seed] = q * np.sign(np.diag(r))
    return _rotations[dim, which, seed]


def layout(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a bucket key, tables): buckets of about BUCKET of n spread-out vectors, and as many tables as leave a
    pair at the threshold apart in all of them with probability MISS at most. Up to BUCKET vectors are one bucket."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))
    if not bits:
        return 0, 1
    bits = min(bits, 32)
    return bits, min(1023, math.ceil(math.log(MISS) / math.log(1 - (1 - math.acos(threshold) / math.pi) ** bits)))


def encode(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """For unit rows x: a bucket key for each table. Sign bits of rotated vectors, taken `bits` at a time over as many rotations as needed."""
    n, dim = x.shape
    if not bits:
        return np.zeros((n, 1), np.int64)
    each = max(1, dim // bits)
    keys = np.zeros((n, tables), np.int64)
    for t in range(tables):
        at = (t % each) * bits
        if bits <= dim:
            signs = x @ rotation(dim, t // each)[:, at : at + bits] > 0
        else:
            signs = np.hstack([x @ rotation(dim, 1000 * (t + 1) + i) > 0 for i in range(-(-bits // dim))])[:, :bits]
        keys[:, t] = signs @ (1 << np.arange(bits, dtype=np.int64))
    return keys


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows x: rotated rows, their sign codes scaled to unit length, and the correction factors <code, rotated>."""
    turned = (x @ rotation(x.shape[1], 0)).astype(np.float32)
    code = np.where(turned > 0, 1, -1).astype(np.float32) / np.float32(math.sqrt(x.shape[1]))
    return turned, code, np.einsum("ij,ij->i", turned, code)


def links_between(a: np.ndarray, b: np.ndarray | None, threshold: float, confidence: float, fresh: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b; b None: of a, the first smaller) with cosine >= threshold, decided by codes where these are sure.

    <code, query> / factor estimates an inner product without bias; its error is sqrt(1 - cos²) times
    sqrt(1 / factor² - 1) / sqrt(dim - 1) in deviation. Only pairs whose upper bound, `confidence` deviations up,
    reaches the threshold, and of these only the fresh, have their cosine computed, from the vectors themselves in
    double precision.
    """
    own = b is None
    b = a if own else b
    an, bn = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    au, bu = a / an[:, None], b / bn[:, None]
    _, code, factor = codes(au)
    turned = codes(bu)[0]
    slack = confidence * math.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(np.maximum(1 / factor.astype(float) ** 2 - 1, 0)) / math.sqrt(max(a.shape[1] - 1, 1))
    found = []
    for at in range(0, len(a), 256):
        rows = slice(at, at + 256)
        hope = (code[rows] @ turned.T) / factor[rows, None] >= (threshold - 1e-5 - slack[rows])[:, None]
        i, j = np.nonzero(hope)
        i += at
        if own:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            if fresh is not None:
                new = fresh(x, y)
                x, y = x[new], y[new]
            near = np.einsum("ij,ij->i", a[x], b[y]) / (an[x] * bn[y]) >= threshold
            found.append((x[near], y[near]))
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def pack_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bucket keys of all tables, `bits` bits each, a row of bytes for each vector."""
    spread = (keys[:, :, None] >> np.arange(bits)) & 1
    return np.packbits(spread.reshape(len(keys), -1).astype(np.uint8), axis=1)


def unpack_keys(rows: np.ndarray, bits: int, tables: int) -> np.ndarray:
    if not bits:
        return np.zeros((len(rows), tables), np.int64)
    return np.unpackbits(rows, axis=1)[:, : tables * bits].reshape(len(rows), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def stored(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is kept of unit rows x: packed sign codes, correction factors, rotated rows in whole steps from -127 to 127, and the step."""
    turned, _, factor = codes(x)
    step = np.maximum(np.abs(turned).max(axis=1), 1e-30) / 127
    return np.packbits(turned > 0, axis=1), factor, np.rint(turned / step[:, None]).astype(np.int8), step.astype(np.float32)


def hopeful(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, step: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float, confidence: float) -> np.ndarray:
    """Which rows are in a pair (of one and two; the same rows: of two different) whose upper bound reaches the threshold.

    The estimate is that of links_between(), from what stored() kept: steps take half a step from each coordinate at most.
    """
    dim = turned.shape[1]
    signs = (np.unpackbits(code, axis=1)[:, :dim].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    slack = confidence * math.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(np.maximum(1 / factor.astype(float) ** 2 - 1, 0)) / math.sqrt(max(dim - 1, 1))
    some, same = np.zeros(len(code), bool), one is two
    for i in range(0, len(one), 256):
        for j in range(i if same else 0, len(two), BLOCK):
            a, b = one[i : i + 256], two[j : j + BLOCK]
            rounding = math.sqrt(dim) * step[b] / 2
            bound = ((signs[a] @ turned[b].astype(np.float32).T) * step[b] + rounding) / factor[a, None] + slack[a, None]
            hope = bound >= threshold - 1e-5
            if same:
                hope &= a[:, None] < b
            x, y = np.nonzero(hope)
            some[a[x]] = some[b[y]] = True
    return some


def near_duplicates(df: DataFrame, threshold: float = 0.9, confidence: float = 4.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row, by cosine >= threshold.

    Equal vectors are one node with a count, so exact copies cost no comparison. Of every node a sign code of its rotated
    vector, its correction factor, and the rotated vector in steps of 8 bits are stored once. A node's key in each table
    is a part of the signs of its rotated vector; for each table its code, without vector and keys, is dealt to the
    bucket of its key, where estimates and their confidence bounds say which nodes may have a link. Only these, in the
    tables that say so, are dealt once more with their vectors, and cosines in double precision decide. A pair counts in
    the first table that brings it together, so no pair is counted twice or sent anywhere: tasks send counts, and a
    spanning forest of the links they found. Buckets of more than BLOCK rows, such as a group of near copies, are dealt
    out as pairs of blocks. A link at the threshold is missed with probability MISS or so, closer ones far more rarely;
    pairs below the threshold never link. Vectors of different lengths don't link.

    Vectors that are null, empty, zero, or hold null or non-finite components come back with no links, as their own
    component, and so do rows without a vec_id (not kept). Rows that repeat a vec_id come back each. An empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    good = rows.filter(is_valid("v") & F.col("vec_id").isNotNull())
    nodes = materialize(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    bits, tables = layout(nodes.count(), threshold)

    def unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, unit vectors) of each length."""
        sizes = np.diff(column.offsets.to_numpy())
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
            yield at, x / np.linalg.norm(x, axis=1)[:, None]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
        for batch in batches:
            for at, x in unit(batch.column("v")):
                code, factor, turned, step = stored(x)
                keys = pack_keys(encode(x, bits, tables), bits)
                rep, n = (batch.column(c).take(pa.array(at)) for c in ("rep", "n"))
                yield pa.RecordBatch.from_arrays([rep, n, pa.array(np.full(len(at), x.shape[1], np.int32)), cells(keys), cells(code), pa.array(factor), cells(turned), pa.array(step)], names=["rep", "n", "dim", "keys", "code", "factor", "turned", "step"])

    kept = materialize(nodes.mapInArrow(encoded, "rep long, n long, dim int, keys binary, code binary, factor float, turned binary, step float"), "codes")

    def matrix(column, kind: str, rows_: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows_, -1)

    def by_table(names: tuple[str, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    keys = unpack_keys(matrix(part.column("keys"), "u1", part.num_rows), bits, tables)
                    of = pa.array(np.repeat(np.arange(part.num_rows), tables))
                    key = (((np.int64(dim) << 10) + np.arange(tables)) << 32) + keys
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(part.column(c).take(of) for c in names)], names=["key", *names])

        return run

    sent = ("rep", "code", "factor", "turned", "step")
    held = kept.mapInArrow(by_table(sent), "key long, rep long, code binary, factor float, turned binary, step float")
    large = materialize(kept.mapInArrow(by_table(()), "key long").groupBy("key").count().filter(F.col("count") > BLOCK), "buckets")
    many = large.count()  # each stands for over BLOCK rows

    def dealt(held: DataFrame, *columns: str) -> DataFrame:
        """held with the task of each row: its bucket, or the pairs of blocks of a large bucket that it is part of."""
        held = held.withColumn("block", F.lit(0)).withColumn("other", F.lit(0))
        if many:
            blocks = F.ceil(F.col("count") / BLOCK).cast("int")
            held = held.join(F.broadcast(large) if many <= 10_000 else large, "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("rep"), blocks).cast("int"), F.lit(0)))
            held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1))).drop("count")
        pair = F.when((F.col("block") == 0) & (F.col("other") == 0), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        return held.select(pair.alias("task"), "key", *columns, (F.col("block") <= F.col("other")).alias("left"), (F.col("block") == F.col("other")).alias("own")).repartition("task").sortWithinPartitions("task")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """The rows of each task, and which of them are to be compared: two sides, or one and the same."""
        for table in complete_runs(batches, "task"):
            cuts = run_bounds(table.column("task").to_numpy())
            for s, e in ((s, e) for s, e in zip(cuts, cuts[1:], strict=False) if e - s > 1):
                group = table.slice(s, e - s)
                one = two = np.arange(e - s)
                if not group.column("own")[0].as_py():
                    left = group.column("left").to_numpy()
                    one, two = np.flatnonzero(left), np.flatnonzero(~left)
                if len(one) and len(two):
                    yield group, one, two

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, one, two in groups(batches):
            n = group.num_rows
            some = hopeful(matrix(group.column("code"), "u1", n), group.column("factor").to_numpy(), matrix(group.column("turned"), "i1", n), group.column("step").to_numpy(), one, two, threshold, confidence)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(group.column(c).to_numpy()[some]) for c in ("key", "rep")], names=["key", "rep"])

    open_rows = dealt(held, *sent).mapInArrow(screen, "key long, rep long").distinct()
    with_vectors = open_rows.join(nodes.join(kept.select("rep", "keys"), "rep"), "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, one, two in groups(batches):
            rep, n, t = group.column("rep").to_numpy(), group.column("n").to_numpy(), (group.column("key")[0].as_py() >> 32) & 1023
            x = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rep), -1)
            sign = unpack_keys(matrix(group.column("keys"), "u1", len(rep)), bits, tables) if t else None
            fresh = (lambda i, j: ~(sign[one[i], :t] == sign[two[j], :t]).any(axis=1)) if t else None  # noqa: B023
            i, j = links_between(x[one], None if one is two else x[two], threshold, confidence, fresh)
            if not len(i):
                continue
            i, j = one[i], two[j]
            count = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
            own = np.flatnonzero(count)
            a, b = forest_edges(rep[i], rep[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[rep[own], a]), pa.array(np.r_[np.zeros(len(own), np.int64), b], mask=np.r_[np.ones(len(own), bool), np.zeros(len(b), bool)]), pa.array(np.r_[count[own].astype(np.int64), np.zeros(len(b), np.int64)])], schema=schema)

    found = materialize(dealt(with_vectors, "rep", "n", "keys", "v").mapInArrow(compare, "a long, b long, links long"), "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    classes = nodes.join(counts, "rep", "left").join(joined, "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(classes, "v").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter(~is_valid("v") | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
