"""Vectors in inverted lists: coarse centroids learned on a bounded sample, exact scores, bounds that say which lists can matter."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.model import stored
from .search import cosine

#: Vectors that the centroids are learned from at most, and centroids at most.
SAMPLE, LISTS = 16384, 4096


def _valid(vector: str) -> Column:
    """Whether a vector has a direction: it has numbers, all finite, and not only zeros."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class VectorIndex:
    """Rows with vectors in a folder, dealt to the list of their nearest centroid; searched by cosine.

    Stored: the rows (without those whose vector is missing, zero or not finite) with `list` and `angle` (to the list's
    centroid), sorted by list so that a filter on it leaves files and row groups unread; `lists`, a row for each list
    with its greatest angle; the centroids. Centroids are learned on SAMPLE vectors at most, drawn by a hash of the key;
    there are about as many as the square root of the number of rows, LISTS at most. All vectors have one length.
    """

    def __init__(self, spark: SparkSession, folder: str, vector: str = "embedding", key: str = "id") -> None:
        self.spark, self.folder, self.vector, self.key = spark, folder.rstrip("/"), vector, key
        self._centers: np.ndarray | None = None

    def build(self, rows: DataFrame, lists: int | None = None, seed: int = 7) -> None:
        """Learn the centroids and write the lists. lists: how many; by default the square root of the number of rows."""
        norm = F.sqrt(F.aggregate(self.vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        unit = F.transform(self.vector, lambda x: x.cast("double") / F.col("_norm"))
        fine = stored(rows.filter(_valid(self.vector)).withColumn("_norm", norm).withColumn("_unit", array_to_vector(unit)).drop("_norm"), "vectors")
        n = fine.count()
        k = max(1, min(lists or math.isqrt(n), LISTS, n))
        self._centers = None
        if not n:
            fine.drop("_unit").withColumn("list", F.lit(0)).withColumn("angle", F.lit(0.0)).write.mode("overwrite").parquet(f"{self.folder}/rows")
            return
        sample = fine.filter(F.pmod(F.xxhash64(self.key, F.lit(seed)), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, SAMPLE / n))).orderBy(F.xxhash64(self.key, F.lit(seed))).limit(SAMPLE)
        model = KMeans(k=k, seed=seed, featuresCol="_unit", predictionCol="list", distanceMeasure="cosine", maxIter=12).fit(sample)
        model.write().overwrite().save(f"{self.folder}/centroids")
        centers = [c / max(np.linalg.norm(c), 1e-300) for c in model.clusterCenters()]
        # k rows of one vector each
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>")
        placed = model.transform(fine).drop("_unit").join(F.broadcast(known), "list")
        angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(F.col(self.vector), F.col("center")))))
        placed = placed.withColumn("angle", angle).drop("center")
        placed.repartitionByRange("list", "angle").sortWithinPartitions("list", "angle").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{self.folder}/rows")
        own = self.spark.read.parquet(f"{self.folder}/rows")
        own.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def _nearest(self, query: Sequence[float]) -> list[dict]:
        """The lists by their angle to the query, with the greatest cosine that any of their vectors can have to it."""
        if self._centers is None:
            found = KMeansModel.load(f"{self.folder}/centroids").clusterCenters()
            self._centers = np.array([c / max(np.linalg.norm(c), 1e-300) for c in found])
        q = np.asarray(query, float) / np.linalg.norm(query)
        angles = np.arccos(np.clip(self._centers @ q, -1, 1))
        held = {r["list"]: r.asDict() for r in self.spark.read.parquet(f"{self.folder}/lists").collect()}
        out = [x | {"to": float(angles[i]), "bound": math.cos(max(0.0, float(angles[i]) - x["angle"] - 1e-7))} for i, x in held.items()]
        return sorted(out, key=lambda x: x["to"])

    def _scored(self, lists: Sequence[int], query: Sequence[float], fine: Column | None) -> DataFrame:
        rows = self.rows().filter(F.col("list").isin(*lists))
        rows = rows if fine is None else rows.filter(fine)
        return rows.select(self.key, cosine(F.col(self.vector), F.array(*(F.lit(float(x)) for x in query))).alias("similarity"))

    def top(self, query: Sequence[float] | None, k: int, fine: Column | None = None, share: float | None = None) -> DataFrame:
        """(key, similarity) of the k rows nearest to a vector among those that `fine` leaves; ties by key.

        The filter is applied before anything is ranked. Without share the result is exact: the nearest lists are read until
        k rows are found, and then every list that can hold a nearer one by its angle. share: only the nearest lists that hold
        this share of all rows are read (and more only if they hold fewer than k), which is fast and may miss some.
        """
        none = self.rows().select(self.key, F.lit(0.0).alias("similarity")).limit(0)
        if query is None or not any(query) or not all(map(math.isfinite, query)) or self.rows().isEmpty():
            return none
        lists = self._nearest(query)
        best = lambda df: df.orderBy(F.desc("similarity"), self.key).limit(k)
        total, at = sum(x["n"] for x in lists), 0
        wanted = max(2 * k, int(total * share) if share else 0)
        found = none
        while at < len(lists) and (at == 0 or found.count() < k):
            begin, held = at, 0
            while at < len(lists) and held < wanted:
                held += lists[at]["n"]
                at += 1
            found = stored(best(found.unionByName(self._scored([x["list"] for x in lists[begin:at]], query, fine))), "near")
            wanted *= 4
        if share:
            return best(found)
        least = found.agg(F.count("*"), F.min("similarity")).first()
        rest = [x["list"] for x in lists[at:] if least[0] < k or x["bound"] >= least[1] - 1e-9]
        return best(found.unionByName(self._scored(rest, query, fine))) if rest else best(found)
