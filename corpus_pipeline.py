"""A corpus pipeline: quality rules, toxicity, near-duplicates, pseudonyms, packing.

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import lineage, minhash, packing, pii, queries, quality_rules, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity cut, by a model fitted on labelled rows among them."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text."""
    new = pii.replace_in(docs, queries.pii_key(spark))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.char_length("text"), F.col("n_chars"))).cast(docs.schema["n_chars"].dataType))
    return new


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(docs, queries.tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", clean),
    ("minhash_near_dedup", near_dedup),
    ("pii", pseudonyms),
    ("best_fit_packing", pack),
]

#: zstandard ratios, trees and token ids have no SQL; tests compare run() with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folders = []
    for _, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := lineage.new_folder(spark))
        folders.append(path)
        docs = spark.read.parquet(path)
    out = STAGES[-1][1](spark, docs, sf_dir)  # has read its documents already: it rests on a checkpoint
    for path in folders:
        lineage.remove(spark, path)
    return out
