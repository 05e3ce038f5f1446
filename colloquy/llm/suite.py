"""The registered queries: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import anglemining, convtrie, fingerprints, langid, lm, ngramjoin, packing, pieces, quality, rpforest, suffixdedup, topk, wavelet
from colloquy.llm.tables import table


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf, "documents"), digests=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = langid.held_out("doc_id", 4)
    found = langid.identify(docs.select("doc_id", "text"), langid.sample(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.learn(docs, table(spark, sf, "labels")))
    return found.select("doc_id", langid.held_out("doc_id", 4).alias("held_out"), "score", "predicted")


def op4_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


def op7_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf, "documents"))


def op8_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lm.scores(table(spark, sf, "documents"), langid.held_out("doc_id", 7))


def op9_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf, "documents"))


def op10_wavelet(spark: SparkSession, sf: str) -> DataFrame:
    path = wavelet.written(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read(spark, path, digests=True)


def op11_rp_forest(spark: SparkSession, sf: str) -> DataFrame:
    return rpforest.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return convtrie.trie(table(spark, sf, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return anglemining.mine(table(spark, sf, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_language_id, op3_quality, op4_topk, op5_pieces, op6_packing, op7_ngram_join, op8_lm_scores, op9_fingerprints, op10_wavelet,
        op11_rp_forest, op12_conversation_trie, op13_hard_negatives,
    )
}
TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v, len(embedding) AS d FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
) SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: crc32 of the decimal id, byte by byte and bit by bit.
CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))),
 lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"""

TRIE_SQL = f"""
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT c, count(*) AS n FROM o GROUP BY c), h AS (SELECT c, c - c % 5 AS base, {CRC32} % 9 AS h FROM n),
pl AS (SELECT h.c, h.h, h.base, least(h.h, coalesce(n.n, 0)) AS m FROM h LEFT JOIN n ON n.c = h.base),
t AS (
  SELECT pl.c, o.p AS d, r, x FROM pl JOIN o ON o.c = pl.base WHERE o.p <= pl.h
  UNION ALL SELECT pl.c, o.p - pl.h + pl.m AS d, r, x FROM pl JOIN o ON o.c = pl.c WHERE o.p > pl.h
), k AS (
  SELECT c, d, octet_length(encode(x)) AS nb, string_agg(md5(r) || md5(x), '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS key FROM t
  UNION ALL SELECT c, 0, 0, '' FROM pl
), nd AS (SELECT d, key, min(c) AS conv_id, count(*) AS n, max(nb) AS nb FROM k GROUP BY d, key),
own AS (SELECT k.c, k.d, nd.conv_id AS o FROM k JOIN nd ON k.d = nd.d AND k.key = nd.key),
par AS (SELECT nd.conv_id, nd.d, nd.n, nd.nb, p.o AS parent FROM nd LEFT JOIN own p ON p.c = nd.conv_id AND p.d = nd.d - 1),
kid AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS kids FROM par WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT par.*, coalesce(kids, 0) AS kids FROM par LEFT JOIN kid ON kid.conv_id = par.conv_id AND kid.d = par.d),
roll AS (
  SELECT p.o AS conv_id, p.d, CAST(count(*) FILTER (w.kids = 0) AS BIGINT) AS leaves, CAST(sum((w.n - 1) * w.nb) AS BIGINT) AS saved
  FROM whole w JOIN own p ON p.c = w.conv_id AND p.d <= w.d GROUP BY 1, 2
), ends AS (
  SELECT own.o AS conv_id, own.d, sha256(string_agg(CAST(own.c AS VARCHAR), ',' ORDER BY own.c)) AS sha
  FROM own JOIN (SELECT c, max(d) AS d FROM k GROUP BY c) l ON l.c = own.c AND l.d = own.d GROUP BY 1, 2
)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, w.parent AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens,
  coalesce(sha, sha256('')) AS ends_sha256
FROM whole w JOIN roll ON roll.conv_id = w.conv_id AND roll.d = w.d LEFT JOIN ends ON ends.conv_id = w.conv_id AND ends.d = w.d
"""

NEGATIVES_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v,
    len(embedding) AS d FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS a, c.vec_id AS i, q.l = c.l AS same, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), pos AS (
  SELECT a, i, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, i) AS r FROM pairs WHERE same
), neg AS (
  SELECT p.a AS anchor_id, p.i AS positive_id, n.i AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.i ORDER BY n.score DESC, n.i) AS INTEGER) AS rank
  FROM pos p JOIN pairs n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score WHERE p.r <= 5
) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""

ORACLES: dict[str, str] = {"op4_topk": TOPK_SQL, "op12_conversation_trie": TRIE_SQL, "op13_hard_negatives": NEGATIVES_SQL}
