"""The queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship
from . import jaccard, language_id, media, minhash, mixing, packing, periodic, pii, quality, repetition, secret_scan, sharding, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(documents(spark, sf_dir), quality.trusted_ids(labels))


@query
def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query
def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op5_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summaries(documents(spark, sf_dir))


ORACLES["op5_trigram_secrets"] = secret_scan.ORACLE


@query
def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


ORACLES["op6_jaccard_components"] = jaccard.ORACLE_LINKS


@query
def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


ORACLES["op7_extendible_shards"] = sharding.ORACLE


@query
def op8_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summaries(documents(spark, sf_dir))


@query
def op9_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(documents(spark, sf_dir))


@query
def op10_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(periodic.rehearsed(documents(spark, sf_dir))))


ORACLES["op12_periodic_runs"] = periodic.ORACLE


@query
def op11_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op11_hamerly_codes"] = vector_codes.ORACLE


@query
def op13_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup(documents(spark, sf_dir))


ORACLES["op13_minhash_components"] = minhash.ORACLE
