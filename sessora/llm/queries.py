"""One thin query per operator, over the whole `documents` table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from sessora.llm import (
    bpe,
    dialogues,
    fingerprints,
    languages,
    manifests,
    media,
    neardups,
    packing,
    quality,
    scoring,
    secrets,
    shards,
    toxicity,
)
from sessora.llm.common import held_out, texts_of
from sessora.llm.oracles import MANIFEST, NEAR_DUPLICATES

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_of(documents(spark, sf_dir))
    model = quality.fit(docs, labels(spark, sf_dir))
    unseen = held_out(quality.MODULUS, quality.HELD_OUT)
    return quality.score(docs, model).select("doc_id", unseen.alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(packing.pack(texts_of(documents(spark, sf_dir))))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_corpus(documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.load(media.store(texts_of(documents(spark, sf_dir))))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    models = languages.fit(docs)
    unseen = held_out(languages.MODULUS, languages.HELD_OUT)
    found = languages.predict(texts_of(docs), models)
    return found.select("doc_id", unseen.alias("held_out"), "lang_pred", "score", "rejected")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(bpe.round_trip(texts_of(documents(spark, sf_dir))))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(texts_of(documents(spark, sf_dir))))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.near_duplicates(documents(spark, sf_dir), width=3, num=85, den=100)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(texts_of(docs), toxicity.fit(docs, labels(spark, sf_dir)))
    return found.select("doc_id", (F.col("predicted") == 1).alias("toxic"), *found.columns[1:])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return dialogues.repair(dialogues.damaged(rows))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return manifests.report(manifests.manifest(docs, manifests.tampered(docs)))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_packing": op2_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_media_columns": op4_media_columns,
    "op5_language_id": op5_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_secret_scan": op7_secret_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_sharding": op11_sharding,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op8_minhash_near_dedup": NEAR_DUPLICATES,
    "op13_merkle_manifest": MANIFEST,
}
