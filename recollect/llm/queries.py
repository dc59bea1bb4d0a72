"""The registered queries of the training-data operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find_pii, listed

    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    of_kind = lambda k: F.filter("pii", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return find_pii(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rabitq import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bestfit import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False, decoded=False, digests=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify, training_rows

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, fit(training_rows(docs))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rpforest import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_rows

    return packed_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def _periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A document's words, a tenth of the documents made periodic from some word on, by a checksum of their id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % period] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import listed, longest, periodic_runs

    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=_periodic, text_out=False).withColumn("run", longest(F.col("runs")))
    exponent = F.expr("1000 * run.length div run.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "run.start", "run.length", "run.period", exponent.alias("exponent_milli"), F.sha2(listed(F.col("runs")), 256).alias("runs_sha256"), "collapsed_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")), gone="gone")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_repeated_lines

    return drop_repeated_lines(table(spark, sf_dir, "documents"), text_out=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_embedding_dedup, op3_best_fit_packing, op4_bpe, op5_token_counts, op6_language_id, op7_simhash, op8_nearest_neighbours, op9_token_output, op10_substring_dedup, op11_periodic_runs, op12_conversation_repair, op13_line_dedup)}
#: All links of valid vectors, then the smallest id reachable, by repeated passes over the links.
_LINKS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
 r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
 c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY 1)
 SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id"""

#: Windows of 13 words, the smallest document that each starts in, and the words under windows that start in a smaller one.
_WINDOWS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
 hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hit), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
 u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w),
 kept AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.j) AS t FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.j = gone.j GROUP BY 1)
 SELECT w.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id"""

#: Lines with their keys, the smallest document of each key of ten characters that two documents hold, and the other lines.
_LINES = r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
 k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
 m AS (SELECT doc_id, line, i, coalesce(first < doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

ORACLE_SQL: dict[str, str] = {"op2_embedding_dedup": _LINKS, "op10_substring_dedup": _WINDOWS, "op13_line_dedup": _LINES}
