"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, graph, pipeline, relative, secrets, sharding, simhash, spelling, suffixes, templates, tokens, toxicity, whitening, winnowing
from .common import table

SHARDS = tuple(f"shard-{k:02d}" for k in range(16))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = (secrets.of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex"))
    return found.select("doc_id", *counts, F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"), F.concat_ws(",", "spans").alias("spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.withColumn("held_out", toxicity.held_out()), model, keep=("doc_id", "held_out"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counts = tokens.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "n_bytes"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_lempel_ziv_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = relative.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.beside_next(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_toxicity, op3_nearest, op4_token_counts, op5_suffix_dedup, op6_lempel_ziv_dedup, op7_sharding, op8_simhash, op9_decontamination, op10_byte_bpe, op11_spelling, op12_winnowing, op13_whitening)} | {"pipeline": pipeline.run}


OP7 = f"""
WITH RECURSIVE shards AS (
  SELECT k, ('0x' || substr(md5('offset:' || name), 1, 8))::BIGINT % {sharding.SLOTS} AS off,
         ('0x' || substr(md5('step:' || name), 1, 8))::BIGINT % {sharding.SLOTS - 1} + 1 AS step, name
  FROM (SELECT k, 'shard-' || lpad(k::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(k))
), turns AS (
  SELECT -1::BIGINT AS t, []::BIGINT[] AS taken, NULL::BIGINT AS slot, NULL::VARCHAR AS shard
  UNION ALL
  SELECT t + 1, list_append(taken, got), got, name FROM (
    SELECT t, taken, name, list_filter(list_transform(range({sharding.SLOTS}), lambda j: (off + j * step) % {sharding.SLOTS}), lambda s: NOT list_contains(taken, s))[1] AS got
    FROM turns JOIN shards ON k = (t + 1) % {len(SHARDS)} WHERE t < {sharding.SLOTS - 1}
  )
)
SELECT doc_id, d.slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5('key:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {sharding.SLOTS} AS slot FROM documents) d
JOIN turns ON turns.slot = d.slot
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_sharding": OP7}
