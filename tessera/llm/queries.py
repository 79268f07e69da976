"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, chunks, cotrain, decontaminate, lm, quality, simhash, toxicity, warc
from tessera.llm.common import table


def op1_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower_bound", "upper_bound", "word_log_perplexity", "word_upper_bound")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.where(~lm.held_out_fold(F.col("doc_id"))))
    rows = lm.scores(docs, model)
    return rows.select("doc_id", lm.held_out_fold(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.classes(table(spark, sf_dir, "documents"), k=4, radius=4)
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.held_out_fold(F.col("_key")))
    return toxicity.scores(docs, lexicon).select("doc_id", toxicity.held_out_fold(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_matches")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "n_words", "distance", "similarity")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cotrain.features(table(spark, sf_dir, "documents"))
    rows = cotrain.scores(made, cotrain.fit(made, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", cotrain.held_out_fold(F.col("doc_id")).alias("held_out"), "score", "predicted", "text_score", "meta_score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.format_preferences(turns, chat.neighbours_as_pairs(turns))


QUERIES = {
    "op1_chunk_dedup": op1_chunk_dedup,
    "op2_quality": op2_quality,
    "op3_lm": op3_lm,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_bpe": op9_bpe,
    "op10_preferences": op10_preferences,
}

SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, trim(regexp_replace(target_uri, '\\s+', ' ', 'g')) AS target_uri, strlen(body) AS n, sha1(body) AS sha FROM p),
b AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS best FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(sha, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to, target_uri, CAST(NULL AS VARCHAR) AS error
FROM b""",
    "op10_preferences": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
p AS (SELECT a.conv_id // 2 AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns AS a, b.turns AS b
  FROM c a JOIN c b ON a.conv_id % 2 = 0 AND b.conv_id = a.conv_id + 1),
k AS (SELECT *, least(len(a), len(b)) AS n, list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]) AS d FROM p),
q AS (SELECT *, CASE WHEN len(d) = 0 THEN n ELSE d[1] - 1 END AS k FROM k),
r AS (SELECT *, a[k + 1:] AS x, b[k + 1:] AS y FROM q)
SELECT pair_id, chosen_id, rejected_id, CAST(k AS BIGINT) AS n_prompt_turns,
  coalesce(array_to_string(list_transform(a[1:k], lambda t: '<|im_start|>' || t.r || chr(10) || t.x || '<|im_end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(x, lambda t: '<|im_start|>' || t.r || chr(10) || t.x || '<|im_end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(y, lambda t: '<|im_start|>' || t.r || chr(10) || t.x || '<|im_end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(x, lambda t: CASE WHEN t.r = 'assistant' THEN '0:' || (13 + length(t.r)) || ',1:' || (length(t.x) + 11) ELSE '0:' || (24 + length(t.r) + length(t.x)) END), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(y, lambda t: CASE WHEN t.r = 'assistant' THEN '0:' || (13 + length(t.r)) || ',1:' || (length(t.x) + 11) ELSE '0:' || (24 + length(t.r) + length(t.x)) END), ','), '') AS rejected_mask
FROM r""",
}
