"""Language identification by the nearest of several centroids per language, in a space of TF-IDF weighted byte trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import long_texts, slices, texts_of

#: Features (a power of two), bytes weighed at once.
FEATURES, STEP = 8192, 1 << 20
#: Features at which a text is half as sure (by squares) as an endless one; cosines of one language then vary least with length.
SHORT = 400

#: Every byte as a feature sees it: ASCII letters and bytes of other characters stand, all else is a space.
_SEEN = np.full(256, 32, np.uint8)
_SEEN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SEEN[128:] = np.arange(128, 256)


def trigrams(text: str) -> np.ndarray:
    """How often each feature occurs in a whole text: hashed byte trigrams of its lower-cased words, one space around each."""
    raw = _SEEN[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]
    space = raw == 32
    raw = raw[np.r_[True, ~(space[1:] & space[:-1])]].astype(np.uint32)
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, max(len(raw) - 2, 0), STEP):
        x = raw[at : at + STEP + 2]
        gram = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(32 - FEATURES.bit_length() + 1), minlength=FEATURES)
    return counts


def stretch(features):
    """What a cosine is multiplied with to make up for few features: short texts of a language are farther from its centroids."""
    return np.sqrt(1 + SHORT / np.maximum(features, 1))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """Learned languages: weights of the features, unit centroids and the language of each, and the least
    cosine (times stretch()) of each language's own rows but a few."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: dict[str, float]

    def predict(self, text: str | None, slack: float = 0.5) -> tuple[str, float, bool]:
        """(language, cosine with its nearest centroid, rejected); und, 0 and true without letters or languages.

        Rejected: farther than slack times what the language's own rows have, for their length. Ties: the first language by name.
        """
        if not has_letter(text) or not self.langs:
            return "und", 0.0, True
        counts = trigrams(text)
        at = np.flatnonzero(counts)
        x = (1 + np.log(counts[at])) * self.idf[at]
        if not len(at):
            return self.langs[0], 0.0, True
        scores = self.centroids[:, at] @ (x / np.sqrt(x @ x))
        best = int(scores.argmax())
        lang, score = self.langs[best], float(min(max(scores[best], 0.0), 1.0))
        return lang, score, bool(score * stretch(len(at)) < slack * self.least[lang])


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Up to k unit centroids of unit rows: the first is next to their mean, each next the farthest from those before; then spherical k-means."""
    centers = x[[int((x @ x.mean(0)).argmax())]]
    while len(centers) < min(k, len(x)):
        centers = np.vstack([centers, x[int((x @ centers.T).max(axis=1).argmin())]])
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        sums = [x[near == i].sum(axis=0) for i in range(len(centers)) if (near == i).any()]
        new = np.array([s / max(np.linalg.norm(s), 1e-12) for s in sums])
        if new.shape == centers.shape and np.allclose(new, centers):
            break
        centers = new
    return centers


def fit(labelled: DataFrame, per_language: int = 400, rows: int = 4000, centroids: int = 4, quantile: float = 0.01) -> Model:
    """Learn from (doc_id, text, lang): at most per_language rows of each language, those of least hash, and `rows` in all.

    The distance from which a text is none of a language is learned, too: `quantile` of its rows are farther from their
    nearest centroid than Model.least. Rows without text, letters or lang teach nothing. Whole texts are weighed in
    Spark's tasks; only their features come to the driver, `rows` * FEATURES counts at most.
    """
    usable = long_texts(labelled).filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    if not sizes:
        return Model(np.ones(FEATURES), np.zeros((0, FEATURES)), [], {})
    each = max(1, min(per_language, rows // len(sizes)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, 2.0 * each / n)))), F.col("lang"))
    drawn = usable.withColumn("draw", draw).filter(F.col("draw") <= rate)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    sample = drawn.withColumn("place", place).filter(F.col("place") <= each).select("lang", "text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(lang, trigrams(t)) for lang, t in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True) if has_letter(t)]
            at = [np.flatnonzero(c) for _, c in found]
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in found], pa.string()), pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([c[a].astype("<i4").tobytes() for a, (_, c) in zip(at, found, strict=True)], pa.binary())], names=["lang", "at", "n"])

    got = sorted((r.lang, bytes(r.at), bytes(r.n)) for r in sample.mapInArrow(weigh, "lang string, at binary, n binary").collect())
    x = np.zeros((len(got), FEATURES), np.float32)
    for row, (_, at, n) in zip(x, got, strict=True):
        row[np.frombuffer(at, "<i4")] = 1 + np.log(np.frombuffer(n, "<i4"))
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x *= idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    langs, centers, least = [], [], {}
    names = np.array([lang for lang, _, _ in got])
    for lang in sorted(set(names)):
        own = cluster(x[names == lang], centroids)
        langs += [str(lang)] * len(own)
        centers.append(own)
        rows_of = x[names == lang]
        least[str(lang)] = float(np.quantile((rows_of @ own.T).max(axis=1) * stretch((rows_of > 0).sum(axis=1)), quantile))
    return Model(idf, np.vstack(centers) if centers else np.zeros((0, FEATURES)), langs, least)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of doc_id as text, modulo 4, is not 2."""
    return docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def identify(docs: DataFrame, model: Model, slack: float = 0.5, row: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (the cosine) and rejected for each row, and `row`, all its columns in one struct, if asked for.

    A row is rejected if it is `und` (text null or without letters) or if its cosine, with regard to its length, is under
    `slack` times what all but a few of the language's own rows have (Model.least). Only the text decides. Empty texts are `und`; long ones are
    weighed whole; repeated rows come back each; an empty table gives no rows. Other columns of docs come back in `row`
    alone, so none clashes. Nothing is shuffled; the model, of bounded size, is broadcast.
    """
    shared = long_texts(docs).sparkSession.sparkContext.broadcast(model)
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if row else []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *whole)
    kept = ["doc_id", *(["row"] if row else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            found = [model.predict(t, slack) for t in batch.column("text").cast(pa.string()).to_pylist()]
            lang, score, far = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=[*kept, "lang_pred", "score", "rejected"])

    out = StructType(list(own.select(*kept).schema))
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        out = out.add(name, kind)
    return own.mapInArrow(run, out)
