"""A stored search index that grows by segments: blocks of postings with upper bounds, tombstones, merges by size."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded, once, query_terms
from ..sources.model import stored
from .index import _runs, _texts
from .versions import Versions

#: Postings in a block, about; levels of weight in a doubling; live segments of one size before they are merged.
BLOCK, STEPS, WIDTH = 128, 4, 4
#: Postings packed at once, and of a bucket in one task, about; keys up to which those of a change are broadcast.
PACK, PART, MANY = 1 << 20, 1 << 20, 1 << 20
K1, B = 1.2, 0.75
#: What a search may filter by; blocks hold postings of one combination, so a filter leaves blocks out whole.
FACETS = ("status", "scope", "project_key", "tool")


def _merged(runs: Column) -> Column:
    """(term, weight) of all fields as one list by term, weights of a term added."""

    def summed(a: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == 1) | (F.get(a, i - 1)["term"] != F.get(a, i - 2)["term"]))
        ends = lambda s, p, j: F.coalesce(F.get(s, j + 1), F.size(a) + 1) - p
        weight = lambda s, p, j: F.aggregate(F.slice(a, p, ends(s, p, j)), F.lit(0.0), lambda t, x: t + x["weight"])
        return once(first, lambda s: F.transform(s, lambda p, j: F.struct(F.get(a, p - 1)["term"].alias("term"), weight(s, p, j).alias("weight"))))

    return once(F.array_sort(runs), lambda a: F.when(F.size(a) > 0, summed(a)).otherwise(F.array().cast("array<struct<term:string,weight:double>>")))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.StringArray, pa.Array]:
    """(row, term, weight) of all terms of a batch of documents."""
    held = batch.column("_terms")
    row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(held)
    return row, pc.struct_field(flat, "term").cast(pa.string()), pc.struct_field(flat, "weight")


def _crc(terms: pa.Array) -> np.ndarray:
    """The CRC-32 of each term, worked out once for equal ones."""
    held = terms.dictionary_encode()
    return np.array([zlib.crc32(t.encode()) for t in held.dictionary.to_pylist()], np.int64)[held.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)


def _over(weight: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """A posting's weight over its item's length, as BM25 has it."""
    return weight / (K1 * ((1 - B) + B * length / mean))


def _packed(key: str, facets: Sequence[str], mean: float, items: int, buckets: int, parts: int):
    """A function that packs postings, some at a time, into one binary for each (bucket, part) in which their blocks lie.

    How many ranges of hashes a group of postings needs is estimated from what is packed at once: hashes are spread evenly.
    """

    def packs(rows: list[tuple[pa.RecordBatch, np.ndarray, pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        docs = sum(b.num_rows for b, *_ in rows)
        of = lambda c: pa.concat_arrays([b.column(c).take(pa.array(r)) for b, r, *_ in rows])
        term, weight = (pa.concat_arrays([x[i] for x in rows]) for i in (2, 3))
        held = pa.table({"term": term, **{f"f{i}": of(c) for i, c in enumerate(facets)}, "key": of(key), "w": weight, "d": of("_d")})
        h, d, w = of("_h").to_numpy().view(np.uint64), held.column("d").to_numpy(), held.column("w").to_numpy()
        level = np.floor(np.log2(_over(w, d, mean)) * STEPS).astype(np.int32)
        # equal terms, facets and levels, numbered
        crc, group = _crc(term), level.astype(np.int64)
        mixed = crc.astype(np.uint64)
        for c in ("term", *(f"f{i}" for i in range(len(facets)))):
            codes = held.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            group = np.unique(group * len(codes.dictionary) + codes.indices.to_numpy(), return_inverse=True)[1]
            if c != "term":
                own = np.array([zlib.crc32(repr(x).encode()) for x in codes.dictionary.to_pylist()], np.uint64)
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[codes.indices.to_numpy()]
        count = np.bincount(group)[group]
        guess = ((count - 1) * (items / docs) + 1) / BLOCK
        bits = np.ceil(np.log2(np.maximum(guess, 1))).astype(np.int32)
        block = np.where(bits > 0, h >> (64 - np.maximum(bits, 1)).astype(np.uint64), 0).astype(np.int64)
        for x in (level, bits, block):
            mixed = (mixed ^ x.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
        target = crc % buckets * parts + (mixed % np.uint64(parts)).astype(np.int64)
        held = held.append_column("level", pa.array(level)).append_column("bits", pa.array(bits)).append_column("block", pa.array(block))
        order = np.lexsort((group, target))
        held, target = held.take(pa.array(order)).combine_chunks(), target[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(target)) + 1, len(target)]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = held.slice(s, e - s)
            own = pa.table([c.dictionary_encode().combine_chunks() if pa.types.is_string(c.type) else c for c in own.columns], names=own.column_names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(own)
            yield pa.RecordBatch.from_arrays([pa.array([int(target[s])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["target", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            row, term, weight = _flat(batch)
            if len(row):
                rows.append((batch, row, term, weight))
                n += len(row)
            if n >= PACK:
                yield from packs(rows)
                rows, n = [], 0
        if rows:
            yield from packs(rows)

    return run


def _blocks(facets: Sequence[str], mean: float, parts: int):
    """A function that makes blocks of the packed postings of one bucket and part."""

    def plain(x: pa.Table) -> pa.Table:
        return pa.table([c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for c in x.columns], names=x.column_names)

    def run(table: pa.Table) -> pa.Table:
        held = pa.concat_tables([plain(pa.ipc.open_stream(x).read_all()) for x in table.column("data").to_pylist()])
        held = held.append_column("over", pa.array(_over(held.column("w").to_numpy(), held.column("d").to_numpy(), mean)))
        by = ["term", *(f"f{i}" for i in range(len(facets))), "level", "bits", "block"]
        made = held.group_by(by, use_threads=False).aggregate([("over", "max"), ("key", "list"), ("w", "list"), ("d", "list")])
        lists = [made.column(f"{c}_list").combine_chunks() for c in ("key", "w", "d")]
        n = pc.list_value_length(lists[0])
        entries = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n.to_numpy())], pa.int32()), pa.StructArray.from_arrays([pc.list_flatten(x) for x in lists], ["key", "w", "d"]))
        bucket = pa.array(np.full(made.num_rows, table.column("target")[0].as_py() // parts), pa.int32())
        return pa.table([*(made.column(c) for c in by), n.cast(pa.int64()), made.column("over_max"), entries, bucket], names=["term", *facets, "level", "bits", "block", "n", "over", "entries", "bucket"])

    return run


def _dead_rows(key: str, facets: Sequence[str], buckets: int):
    """A function that makes of documents (segment, key, facets, _d, _terms) a row for each bucket of their terms, and one in bucket -1 without terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, _ = _flat(batch)
            bucket = _crc(term) % buckets
            order = np.lexsort((bucket, row))
            row, bucket, term = row[order], bucket[order], term.take(pa.array(order))
            cuts = np.r_[0, np.flatnonzero(np.diff(row) | np.diff(bucket)) + 1] if len(row) else np.zeros(0, np.int64)
            every = np.arange(batch.num_rows)
            at, where = np.r_[every, row[cuts]], np.r_[np.full(len(every), -1), bucket[cuts]]
            offsets = np.r_[np.zeros(len(every), np.int64), cuts, len(row)]
            terms = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), term)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("segment", key, *facets, "_d")), terms, pa.array(where, pa.int32())], names=["of", key, *facets, "_d", "terms", "bucket"])

    return run


class SearchIndex:
    """BM25 over weighted fields of items, out of tables in a folder.

    Tables, each partitioned by segment: `docs` (an item's facets, length, terms, stamp and stored columns, by hash of the
    key), `postings` (blocks), `totals` (items and lengths by facets), `dead` (postings of items that a later segment
    replaces or that are gone, by item and bucket of the term). A block holds the postings of one term, one combination of facets, one level of weight
    over length and one range of key hashes: its header tells how many there are and how much any can weigh, so a
    search reads headers first and then only blocks that can hold one of the best items or a known candidate's posting.

    What is live stands in a log of small commits (`Versions`); folders of a commit that failed are never read. A change
    writes the changed items and the postings that they replace, nothing else; WIDTH live segments of one size (a power
    of WIDTH) become one, so an item is written again as often as the logarithm of their number. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: Mapping[str, float], key: str = "id", facets: Sequence[str] = FACETS, left_out: Sequence[str] = ("details",), buckets: int = 32) -> None:
        """left_out: columns of items that aren't stored (long texts); buckets: as the index was written."""
        self.spark, self.folder, self.fields, self.key, self.facets = spark, folder.rstrip("/"), dict(fields), key, list(facets)
        self.left_out, self.buckets = set(left_out), buckets
        self.log = Versions(spark, f"{self.folder}/log")
        self._read: dict[str, tuple[tuple[str, ...], DataFrame]] = {}

    # --- upkeep -------------------------------------------------------------------------------------------------

    def _documents(self, items: DataFrame) -> DataFrame:
        """The rows of `docs` for items."""
        texts = _texts(items, self.fields)
        length = sum((F.regexp_count(folded(t), F.lit(r"[\p{L}\p{N}]+")) for t in texts), F.lit(0)).cast("long")
        runs = F.concat(*(_runs(text, float(w)) for text, w in zip(texts, self.fields.values(), strict=True)))
        kept = [c for c in items.columns if c not in self.left_out]
        stamp = F.sha1(F.concat_ws("\u0001", *(F.coalesce(c.cast("string"), F.lit("\u0002")) for c in [*texts, *(F.col(c) for c in kept)])))
        return items.select(F.xxhash64(self.key).alias("_h"), stamp.alias("_stamp"), length.alias("_d"), _merged(runs).alias("_terms"), *kept)

    def _write(self, documents: DataFrame, tag: str) -> tuple[str, int]:
        """A new segment of rows of `docs`, which are sorted by hash within their partitions; its name and size.

        Documents are worked out once and written where they are; only packed postings are shuffled, once.
        """
        name, kinds = f"{tag}-{uuid.uuid4().hex[:12]}", dict(documents.dtypes)
        at = lambda table: f"{self.folder}/{table}/segment={name}"
        documents.write.option("parquet.block.size", 8 << 20).option("compression", "zstd").parquet(at("docs"))
        own = self.spark.read.schema(documents.schema).parquet(at("docs"))
        totals = own.groupBy(*self.facets).agg(F.count("*").alias("n"), F.sum("_d").alias("d"), F.sum(F.size("_terms")).alias("terms"))
        totals.coalesce(1).write.parquet(at("totals"))
        size, total, terms = self.spark.read.schema(totals.schema).parquet(at("totals")).agg(F.sum("n"), F.sum("d"), F.sum("terms")).first()
        if not size:
            return name, 0
        mean, parts = max(total / size, 1e-9), max(1, -(-terms // (self.buckets * PART)))
        rows = own.select("_h", self.key, "_d", *self.facets, "_terms")
        packed = rows.mapInArrow(_packed(self.key, self.facets, mean, size, self.buckets, parts), "target int, data binary")
        known = ", ".join(f"`{c}` {kinds[c]}" for c in self.facets)
        schema = f"term string, {known}, level int, bits int, block long, n long, over double, entries array<struct<key:{kinds[self.key]},w:double,d:long>>, bucket int"
        blocks = packed.groupBy("target").applyInArrow(_blocks(self.facets, mean, parts), schema).withColumn("mean", F.lit(mean))
        blocks.sortWithinPartitions("bucket", "term", "level").write.option("parquet.block.size", 4 << 20).option("compression", "zstd").partitionBy("bucket").parquet(at("postings"))
        return name, size

    def build(self, items: DataFrame) -> None:
        """Items in place of all that the index held."""
        name, n = self._write(self._documents(items.sortWithinPartitions(F.xxhash64(self.key))), "seg")
        self.log.commit({name: n} if n else {}, list(self.log.live()))

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Put items in (new ones, and new versions of known ones; those that are as they were are left alone), and take the keys of `deleted` out.

        A key that both name is put in. Written: the changed items, their postings, and those of the versions they replace.
        """
        live, added = self.documents(), {}
        keys = [deleted.select(self.key)] if deleted is not None else []
        if keys and changed is not None:
            keys = [keys[0].join(changed.select(self.key), self.key, "left_anti")]
        if changed is not None:
            fresh = self._documents(changed)
            if live is not None:
                fresh = fresh.join(live.select(self.key, "_stamp"), [self.key, "_stamp"], "left_anti")
            name, n = self._write(fresh.sortWithinPartitions("_h"), "seg")
            if n:
                added[name] = n
                keys.append(self.spark.read.schema(fresh.schema).parquet(f"{self.folder}/docs/segment={name}").select(self.key))
        if live is not None and keys:
            keys = stored(reduce(DataFrame.unionByName, keys).distinct(), "keys")
            # the documents' terms are shuffled only for a change of very many
            some = F.broadcast(keys) if keys.count() <= MANY else keys
            added |= self._bury(live.select("segment", self.key, *self.facets, "_d", "_terms").join(some, self.key, "left_semi"))
        if added:
            self.log.commit(added)
            self.merge()

    def _bury(self, old: DataFrame) -> dict[str, int]:
        """Write the postings and totals of versions that are gone; {name: number of versions}."""
        name, kinds = f"dead-{uuid.uuid4().hex[:12]}", dict(old.dtypes)
        known = ", ".join(f"`{c}` {kinds[c]}" for c in (self.key, *self.facets))
        rows = old.mapInArrow(_dead_rows(self.key, self.facets, self.buckets), f"of string, {known}, _d long, terms array<string>, bucket int")
        path = f"{self.folder}/dead/batch={name}"
        rows.repartition("bucket").sortWithinPartitions("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        n = self.spark.read.schema(rows.schema).parquet(path).filter("bucket = -1").count()
        return {name: n} if n else {}

    def merge(self, everything: bool = False) -> None:
        """Make one segment of WIDTH or more of a size, until there are none; everything: of all that is live."""
        while True:
            live = {k: n for k, n in self.log.live().items() if k.startswith("seg-")}
            tiers: dict[int, list[str]] = {}
            for k, n in live.items():
                tiers.setdefault(0 if everything else int(math.log(max(n, 1), WIDTH)), []).append(k)
            full = [ks for _, ks in sorted(tiers.items()) if len(ks) >= (2 if everything else WIDTH)]
            if everything and not full and self._buried() is not None:
                full = [list(live)]
            if not full:
                return
            ks = full[0]
            name, n = self._write(self._alive(self._table("docs", ks)).drop("segment").sortWithinPartitions("_h"), "seg")
            self.log.commit({name: n} if n else {}, ks)
            if dead := self._live("dead-"):
                of_live = self._table("dead", dead, "batch").filter(F.col("of").isin(*self._live("seg-"))).select("batch").distinct()
                used = {r[0] for r in of_live.collect()}
                self.log.commit({}, [k for k in dead if k not in used])

    # --- reading ------------------------------------------------------------------------------------------------

    def _table(self, name: str, live: Sequence[str], by: str = "segment") -> DataFrame:
        """Live rows of a table; its files are listed again only when something was committed."""
        state = tuple(self.log.live())
        if name not in self._read or self._read[name][0] != state:
            self._read[name] = state, self.spark.read.parquet(f"{self.folder}/{name}")
        return self._read[name][1].filter(F.col(by).isin(*live))

    def _live(self, kind: str) -> list[str]:
        return [k for k in self.log.live() if k.startswith(kind)]

    def _buried(self) -> DataFrame | None:
        """The rows of `dead` that are of live segments; None if there is no batch of them."""
        dead = self._live("dead-")
        return self._table("dead", dead, "batch").filter(F.col("of").isin(*self._live("seg-"))) if dead else None

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, key) without those that are dead."""
        dead = self._buried()
        if dead is None:
            return rows
        return rows.join(dead.filter("bucket = -1").select(F.col("of").alias("segment"), self.key), ["segment", self.key], "left_anti")

    def documents(self) -> DataFrame | None:
        """The live rows of `docs`; None before anything was written."""
        live = self._live("seg-")
        return self._alive(self._table("docs", live)) if live else None

    def items(self) -> DataFrame | None:
        """The stored columns of the live items, long texts left out."""
        docs = self.documents()
        return docs.drop("_h", "_stamp", "_d", "_terms", "segment") if docs is not None else None

    def fetch(self, keys: DataFrame, most: int = 512) -> DataFrame:
        """The stored columns of some items. Up to `most` keys are looked for by their hash in the sorted files, more by a join."""
        docs = self.documents()
        found = [r[0] for r in keys.select(F.xxhash64(self.key)).limit(most + 1).collect()]
        if len(found) <= most:
            docs = docs.filter(reduce(lambda x, y: x | y, (F.col("_h") == h for h in found), F.lit(False)))
        return docs.join(keys.select(self.key), self.key, "left_semi").drop("_h", "_stamp", "_d", "_terms", "segment")

    def _postings(self, terms: Sequence[str], fine: Column) -> DataFrame:
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self._table("postings", self._live("seg-")).filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms) & fine)

    def _dead_terms(self, terms: Sequence[str], fine: Column) -> DataFrame | None:
        dead = self._buried()
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return None if dead is None else dead.filter(F.col("bucket").isin(*buckets) & fine).select("of", self.key, F.explode("terms").alias("term")).filter(F.col("term").isin(*terms))

    def _entries(self, blocks: DataFrame, dead: DataFrame | None) -> DataFrame:
        """(term, key, weight, d, h): the live postings in some blocks."""
        rows = blocks.select("segment", "term", F.explode("entries").alias("e")).select("segment", "term", F.col("e.key").alias(self.key), F.col("e.w").alias("weight"), F.col("e.d").alias("d"), F.xxhash64("e.key").alias("h"))
        if dead is not None:
            rows = rows.join(dead.select(F.col("of").alias("segment"), self.key, "term"), ["segment", self.key, "term"], "left_anti")
        return rows.drop("segment")

    def top(self, query: str, fetch: int, fine: Column | None = None, tags: Column | None = None) -> DataFrame:
        """(key, score) of the best `fetch` items: by BM25, then the greater confidence (if stored), then key. Statistics are those of the items that the filter leaves.

        fine: a condition on the facets; tags: a condition on stored columns (with it the terms' postings are read whole).
        """
        terms, fine = query_terms(query), F.lit(True) if fine is None else fine
        none = self.spark.createDataFrame([], f"{self.key} {self._key_type()}, score double")
        if not terms or not self._live("seg-"):
            return none
        dead = self._dead_terms(terms, fine)
        if tags is not None:
            return self._whole(terms, fine, tags, dead, fetch)
        totals = self._table("totals", self._live("seg-")).filter(fine).agg(F.sum("n"), F.sum("d")).first()
        n, d = totals[0] or 0, totals[1] or 0
        lost: dict[str, int] = {}
        if dead is not None:
            buried = self._buried().filter(fine & (F.col("bucket") == -1)).agg(F.count("*"), F.sum("_d")).first()
            n, d = n - buried[0], d - (buried[1] or 0)
            lost = {r[0]: r[1] for r in dead.groupBy("term").count().collect()}
        if not n:
            return none
        mean = max(d / n, 1e-9)
        blocks = self._postings(terms, fine)
        over = F.max(F.col("over") * F.greatest(F.lit(1.0), F.lit(mean) / F.col("mean")))
        levels = [r.asDict() for r in blocks.groupBy("term", "level").agg(F.sum("n").alias("n"), over.alias("over"), F.collect_set("bits").alias("bits"), F.max("bits").alias("most")).collect()]
        df = {t: sum(x["n"] for x in levels if x["term"] == t) - lost.get(t, 0) for t in terms}
        idf = {t: max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) for t in terms if df[t] > 0}
        lists = {t: sorted((x for x in levels if x["term"] == t), key=lambda x: -x["over"]) for t in idf}
        for t, own in lists.items():
            for x in own:
                x["cap"] = idf[t] * (K1 + 1) * x["over"] / (1 + x["over"])
            for x, y in zip(own[-2::-1], own[:0:-1], strict=True):  # no level promises more than one before it
                x["cap"] = max(x["cap"], y["cap"])
        if not idf:
            return none
        idf_of = F.element_at(F.create_map(*(F.lit(v) for kv in idf.items() for v in kv)), F.col("term"))
        scored = lambda rows: rows.withColumn("score", idf_of * F.col("weight") * (K1 + 1) / (F.col("weight") + K1 * ((1 - B) + B * F.col("d") / mean)))
        at_levels = lambda chosen: reduce(lambda x, y: x | y, ((F.col("term") == t) & F.col("level").isin(*ls) for t, ls in chosen.items() if ls), F.lit(False))

        # the score that the last of the best has at least: partial scores of the first postings of each term
        begin = F.lit(False)
        for t, own in lists.items():
            found = 0
            for x in own:
                if found < 2 * fetch:
                    found += x["n"]
                    # of a long level the first ranges of hashes, which hold so many postings
                    some = min(1.0, 4 * fetch / x["n"])
                    begin = begin | (F.col("term") == t) & (F.col("level") == x["level"]) & (F.col("block") < F.ceil(F.pow(2, "bits") * some))
        first = scored(self._entries(blocks.filter(begin), dead)).groupBy(self.key).agg(F.sum("score").alias("score"))
        best = first.orderBy(F.desc("score")).limit(fetch).agg(F.count("*"), F.min("score")).first()
        least = best[1] if best[0] >= fetch else 0.0

        # whole levels from the top, until what is unread can't lift an item that wasn't seen to that score
        at = dict.fromkeys(lists, 0)
        cap = lambda t: lists[t][at[t]]["cap"] if at[t] < len(lists[t]) else 0.0
        while sum(map(cap, lists)) >= least * (1 - 1e-9) and any(at[t] < len(lists[t]) for t in lists):
            gain = {}
            for t, own in lists.items():
                if at[t] < len(own):
                    after = own[at[t] + 1]["cap"] if at[t] + 1 < len(own) else 0.0
                    gain[t] = (own[at[t]]["cap"] - after) / own[at[t]]["n"]
            at[max(gain, key=gain.get)] += 1
        read = {t: [x["level"] for x in own[: at[t]]] for t, own in lists.items()}
        rest = {t: own[at[t] :] for t, own in lists.items()}
        marks = {t: F.bit_or(F.when(F.col("term") == t, 1).otherwise(0)).alias(f"_s{i}") for i, t in enumerate(lists)}
        seen = scored(self._entries(blocks.filter(at_levels(read)), dead)).groupBy(self.key).agg(F.sum("score").alias("score"), F.first("h").alias("h"), *marks.values())
        might = F.col("score") + sum((F.when(F.col(f"_s{i}") == 0, cap(t)).otherwise(0.0) for i, t in enumerate(lists)), F.lit(0.0))
        seen = stored(seen.filter(might >= least * (1 - 1e-9)), "candidates")
        if any(rest.values()):
            bits = sorted({b for own in rest.values() for x in own for b in x["bits"]})
            places = seen.select(self.key, "h", F.explode(F.array(*map(F.lit, bits))).alias("bits"))
            places = places.withColumn("block", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)")))
            wanted = places.select("bits", "block").distinct()
            hit = blocks.filter(at_levels({t: [x["level"] for x in own] for t, own in rest.items()})).join(wanted, ["bits", "block"], "left_semi")
            more = scored(self._entries(hit, dead)).join(seen.select(self.key), self.key, "left_semi").select(self.key, "score")
            seen = seen.select(self.key, "score").unionByName(more).groupBy(self.key).agg(F.sum("score").alias("score"))
        return self._first(stored(seen.select(self.key, "score"), "scored"), fetch)

    def _first(self, scored: DataFrame, fetch: int) -> DataFrame:
        """The best of some scores, ties by confidence and key."""
        best = scored.orderBy(F.desc("score")).limit(fetch).select("score").collect()
        if not best:
            return scored.select(self.key, "score")
        near = scored.filter(F.col("score") >= best[-1]["score"])
        known = self.fetch(near)
        sure = [F.desc("confidence")] if "confidence" in known.columns else []
        return near.join(known, self.key).orderBy(F.desc("score"), *sure, self.key).limit(fetch).select(self.key, "score")

    def _whole(self, terms: Sequence[str], fine: Column, tags: Column, dead: DataFrame | None, fetch: int) -> DataFrame:
        """As top, from all postings of the terms and the items that a condition on stored columns leaves."""
        shown = self.documents().filter(fine & tags).select(self.key, "_d")
        stats = shown.agg(F.count("*").alias("n"), F.avg("_d").alias("mean"))
        rows = self._entries(self._postings(terms, fine), dead).join(shown.select(self.key), self.key, "left_semi")
        of_term = rows.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        w = F.col("weight")
        score = idf * w * (K1 + 1) / (w + K1 * ((1 - B) + B * F.col("d") / F.col("mean")))
        # a row for each term of the query
        scored = rows.join(F.broadcast(of_term), "term").withColumn("score", score).groupBy(self.key).agg(F.sum("score").alias("score"))
        return self._first(stored(scored, "scored"), fetch)

    def _key_type(self) -> str:
        live = self._live("seg-")
        return dict(self._table("docs", live).dtypes)[self.key] if live else "string"
