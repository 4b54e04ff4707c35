"""From raw documents to packed sequences: quality, language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the
last return the columns of documents, extra ones too. `run` writes each stage as Parquet into the
shared folder and rereads it, so that no stage repeats another's work and a lost executor costs no
more than the stage it was in. A stage's table goes once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessora.llm import languages, neardups, packing, quality, secrets
from sessora.llm.common import remove, shared_folder

#: Words that a Python worker remembers in the last stage, next to what the stages before it left.
PACKED_WORDS = 150_000

#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learned from the labels, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that are in none of the languages learned from `lang`, or have no letter."""
    return languages.accepted(docs, languages.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8 or more."""
    return neardups.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its ids, and where they lie."""
    return packing.pack(docs, cached=PACKED_WORDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of `documents`."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
