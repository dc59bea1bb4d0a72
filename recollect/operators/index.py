"""Tables that searches and upserts keep: postings, incremental differences, appends that ignore what is known."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, once, tokens


def _runs(text: Column, weight: float) -> Column:
    """(term, weight) of each distinct token of a text: tokens are sorted and runs of equal ones measured, so long texts cost little more than a sort."""

    def measured(a: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == 1) | (F.get(a, i - 1) != F.get(a, i - 2)))
        return once(first, lambda s: F.transform(s, lambda p, j: F.struct(F.get(a, p - 1).alias("term"), ((F.coalesce(F.get(s, j + 1), F.size(a) + 1) - p) * F.lit(weight)).alias("weight"))))

    return once(F.array_sort(tokens(text)), lambda a: F.when(F.size(a) > 0, measured(a)).otherwise(F.array().cast("array<struct<term:string,weight:double>>")))


def _texts(items: DataFrame, fields: Iterable[str]) -> list[Column]:
    is_list = {n for n, t in items.dtypes if t.startswith("array")}
    return [F.array_join(f, " ") if f in is_list else F.col(f) for f in fields]


def postings(items: DataFrame, fields: Mapping[str, float], key: str = "id") -> DataFrame:
    """(term, key, weight): how often a term occurs in an item, fields weighted; repeats are counted within the row before anything is shuffled."""
    runs = F.concat(*(_runs(text, float(w)) for text, w in zip(_texts(items, fields), fields.values(), strict=True)))
    return items.select(key, F.explode(runs).alias("r")).select(key, "r.*").groupBy("term", key).agg(F.sum("weight").alias("weight"))


def write_search_index(items: DataFrame, folder: str, fields: Mapping[str, float], key: str = "id", buckets: int = 64, parts: int = 8) -> None:
    """The stored index that `search.bm25_indexed` reads: postings by bucket of the term, sorted by term, and lengths of items.

    One shuffle, by the bucket and a hash of the key, so a term that most items hold is dealt to `parts` tasks and files
    (more of both for larger corpora); a search reads the buckets of its terms, and of their files the row groups that
    can hold them. Items without a token have a length of 0.
    """
    texts = _texts(items, fields)
    length = sum((F.regexp_count(folded(t), F.lit(r"[\p{L}\p{N}]+")) for t in texts), F.lit(0)).cast("long")
    runs = F.concat(*(_runs(text, float(w)) for text, w in zip(texts, fields.values(), strict=True)))
    # the length is worked out below the explode, once for an item
    rows = items.select(key, length.alias("d"), runs.alias("runs")).select(key, "d", F.explode("runs").alias("r")).select(key, "d", "r.*")
    rows = rows.withColumn("bucket", term_bucket("term", buckets)).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
    found = rows.repartition("bucket", "_part").groupBy("bucket", "_part", "term", key).agg(F.sum("weight").alias("weight"), F.first("d").alias("d"))
    found.drop("_part").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("parquet.block.size", 16 << 20).parquet(f"{folder}/postings")
    items.select(key, length.alias("d")).write.parquet(f"{folder}/lengths")


def term_bucket(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)).cast("int")


def term_counts(items: DataFrame, text: str, key: str = "id") -> DataFrame:
    """(key, term, tf) of one field."""
    return items.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def insert_or_ignore(known: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new whose key isn't known, the first of each key in the order of all columns."""
    rest = [c for c in new.columns if c != key]
    fresh = new.join(known.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*new.columns)


def difference(indexed: DataFrame, current: DataFrame, key: str = "id", stamp: str = "sha1") -> DataFrame:
    """(key, change) between what is indexed and what there is: added, updated or deleted; equal stamps are left alone."""
    old, new = indexed.select(key, F.col(stamp).alias("_old")), current.select(key, F.col(stamp).alias("_new"))
    rows = old.join(new, key, "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return rows.select(key, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("updated").alias("change"))


def upsert(known: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new over known: known rows without a new one, and all new rows."""
    return known.join(new.select(key), key, "left_anti").unionByName(new)
