"""From raw documents to training pieces: five stages, each over all that the one before kept.

1. language_id: documents whose language can't be told (no letters, or a posterior below LEAST_SCORE) go; a missing
   language is filled in.
2. near_dedup: one document of each group of near copies stays (five-word shingles, similarity 0.8 or more).
3. secret_scan: secrets are written as <SECRET>; n_chars follows the text.
4. mixing: documents are repeated or left out so that the sources come near their target weights.
5. sentencepiece: each document's sampled pieces.

A stage takes and returns a table with the columns of ``documents`` (the last: key, language, source and pieces);
tables are written between the stages, so a lost executor never repeats an earlier one. Null texts count as empty:
they have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import language, mixing, neardup, pieces, secretscan
from veritab.llm.columns import fresh_name
from veritab.session import durable

LEAST_SCORE = 0.5
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = language.identify(docs, language.train(docs))
    predicted, score = (F.col(f"`{fresh_name(docs, c)}`") for c in ("lang_pred", "score"))  # as identify names them
    kept = told.where((predicted != language.UNDETERMINED) & (score >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", predicted)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, length=SHINGLE, percent=PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secretscan.redact(docs, secretscan.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select(
        "doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids"
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Trained models, clusters and sampled pieces aren't SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
