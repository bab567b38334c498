"""A training corpus from the table documents, in five stages.

Toxic documents go; of near-duplicates one document stays; documents that leak a benchmark item go;
secrets are masked; what is left is encoded. Each stage is written as Parquet in the shared folder and
read again as the next one's input; its folder goes once the next one's is whole. A document is a row: of texts that share an id, or have none, each is
judged by itself; a null text stays null until it is encoded as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odlake.sources.folder import Folder

from . import bpe, copies, secrets, simhash, templates, toxicity
from .common import shared_folder, table, without

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, keep=tuple(docs.columns), score="__score", predicted="__toxic").where("__toxic = 0").select(*docs.columns)


def by_fingerprint(texts: DataFrame) -> DataFrame:
    """node, key: the SimHash component, found at the anchors of the covering code, that a text is in."""
    found = simhash.near_duplicates(texts.select(F.col("node").alias("doc_id"), "text"))
    return found.groupBy(F.col("doc_id").alias("node")).agg(F.xxhash64(F.first("component_id"), F.lit("simhash")).alias("key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of one SimHash component meet and are checked exactly; so are those of a min-hash band, as most texts at a similarity of 0.8 differ in more bits than SimHash links."""
    return copies.one_of_each(docs, also=by_fingerprint)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")  # tells texts of one id, or of none, apart
    rows = docs.withColumn("__row", row)
    found = templates.leaks(rows.select(F.col("__row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, found.select(F.col("doc_id").alias("__row")).distinct(), key="__row").select(*docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = bpe.encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "n_chars"))
    return made.withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", leaked),
    ("secrets", masked),
    ("byte_bpe", encoded),
]
#: Models, components, templates and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:  # nothing reads it any more
            Folder(spark, folder).remove(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
