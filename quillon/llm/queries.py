"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, neardup, packing, pii, prefixbpe, quality, tokenfile, topk, toxicity, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return prefixbpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learn(toxicity.training_rows(docs, table(spark, folder, "labels")))
    return toxicity.score(docs, model).select("doc_id", (toxicity.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_passages", "worst")


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(table(spark, folder, "documents"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.learn(langid.training_rows(docs))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantised(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, 20, F.col("vec_id") % 20 == 0)


def op10_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replaced(table(spark, folder, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_byte_bpe, op4_toxicity, op5_near_duplicates, op6_token_files, op7_language_id, op8_warc, op9_top_k, op10_pii_surrogates)}


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""


_GRID = ", ".join(f"({r}, {p}, CAST({v} AS DOUBLE))" for r, cutoffs in enumerate(quality.GRID.values()) for p, v in enumerate(cutoffs))
_RULES = " ".join(f"WHEN {r} THEN '{name}'" for r, name in enumerate(quality.GRID))
_EACH = quality.ALPHA / len(quality.GRID)
OP2_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS s, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w, list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS many FROM g), (SELECT unnest(range(0, 5)) AS k) WHERE many > 1 GROUP BY doc_id),
f AS (SELECT w.doc_id, s, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
v AS (SELECT doc_id, s, base_failed, 0 AS rule, coalesce(n_symbols / nullif(word_chars, 0), 0) AS v FROM b UNION ALL SELECT doc_id, s, base_failed, 1, coalesce(n_dup_lines / nullif(n_lines, 0), 0) FROM b
 UNION ALL SELECT doc_id, s, base_failed, 2, coalesce(n_repeat_words / nullif(n_words, 0), 0) FROM b UNION ALL SELECT doc_id, s, base_failed, 3, coalesce(word_chars / nullif(n_words, 0), 0) FROM b),
q AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
grid AS (SELECT * FROM (VALUES {_GRID}) g(rule, place, cutoff)),
h AS (SELECT s, rule, v, q FROM v JOIN q ON v.doc_id = q.doc_id WHERE NOT base_failed),
n AS (SELECT s, h.rule, place, cutoff, count(*) FILTER (q = 1) AS good, count(*) FILTER (q = 1 AND v > cutoff) AS lost, count(*) FILTER (q = 0 AND v > cutoff) AS caught FROM h JOIN grid ON h.rule = grid.rule GROUP BY 1, 2, 3, 4),
p AS (SELECT *, CASE WHEN good = 0 OR lost >= good THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({_EACH}) + (good - i) * ln(1 - {_EACH})))) END AS tail FROM n),
k AS (SELECT *, bool_and(tail <= {quality.DELTA} / ((SELECT count(DISTINCT s) FROM h) * {len(quality.GRID)})) OVER (PARTITION BY s, rule ORDER BY place) AS certified, caught - {quality.PENALTY} * lost AS gain FROM p),
z AS (SELECT s, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY s, rule ORDER BY gain DESC, place) AS rk FROM k WHERE certified AND gain > 0) WHERE rk = 1),
r AS (SELECT v.doc_id, min(v.rule) AS rule FROM v JOIN z ON v.s = z.s AND v.rule = z.rule AND v.v > z.cutoff GROUP BY 1)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND r.rule IS NULL AS kept, CASE WHEN base_failed THEN 'base' ELSE CASE r.rule {_RULES} END END AS rejected_by FROM b LEFT JOIN r ON b.doc_id = r.doc_id
"""

OP9_SQL = """
WITH ok AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM ok),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op8_warc": OP8_SQL, "op9_top_k": OP9_SQL}
