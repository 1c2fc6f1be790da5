"""From raw documents to clean tokens: five stages, each written and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeguard.llm import bpe, contamination, near_dups, pii, quality_rules
from changeguard.llm.common import stored
from changeguard.llm.settings import PII_KEY, RANKS


#: Percent of shared shingles from which two texts are near copies.
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts; failed and depleted documents go."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dups.one_of_each(docs, similarity=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, or its question and answer apart, go."""
    return contamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), parts=True)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced in the texts."""
    done = pii.surrogates(docs, PII_KEY).select(*(f"`{c}`" for c in docs.columns))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with their digests and counts."""
    path = public_tokenizers.path(RANKS)
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, ids=True).drop("text")


STAGES = [("quality_rules", quality), ("near_dups", near_duplicates), ("decontamination", decontamination), ("pii_surrogates", private_data), ("byte_bpe", encoding)]

#: PII surrogates and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
