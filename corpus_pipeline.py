"""A training corpus from raw documents: score, deduplicate, redact, mix, pack.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Null and empty texts have no perplexity and go in the first stage. A null language is a language, a null source a source of
its own. Rows without an id, and rows that share one, are documents like all others. Of near duplicates, exact copies and
repeated rows the one with the least id stays; of several with that id the first, in the order of blocks; rows without an
id stay only where no other does. Texts of any length are taken whole. Other columns, whatever their names, go along until
the documents are packed. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.llm import jaccard, mixing, packing, quality, secret_scan
from lidarlake.runtime import cut, discard, recorded, ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted text's model is above their language's threshold go."""
    ship(spark)
    return quality.Judged(docs, quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))).keep()


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    ship(spark)
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret gives way to a mark; n_chars follows the text."""
    ship(spark)
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    ship(spark)
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of fixed capacity."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_distinct),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no perplexity model, pivotal rounding or tokenizer: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. When a stage's output is written, its input goes, and so does all that it wrote on its way."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        docs = cut(out)
        made.drop(spark)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
