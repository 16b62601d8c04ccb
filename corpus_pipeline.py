"""A pipeline over documents: quality rules, near duplicates, repeated passages, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result as
Parquet in the shared folder and reads it again for the next. All stages but the last return the columns of
their input, which are those of documents and any others; the last returns doc_id, n_tokens and ids.

Defined results: empty tables stay empty; null or empty texts go in the first stage, as do those of few words;
of repeated rows of one id the rules judge each; a text that is cut keeps its row, and n_chars is counted anew;
a text that loses every byte in stage 3 (it stands whole in earlier documents) loses its row too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import bpe, decontaminate, jaccard, repetition, suffixes
from strandmill.llm.shared import Tables, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return repetition.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that stand in an earlier document."""
    return suffixes.cut(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document that is left."""
    return bpe.encode(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("bpe_encoding", tokens),
]

#: Stages 1 and 5 can't be said in SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark, "pipeline", kept=True)
    for name, stage in STAGES:
        with scratch(spark):
            before, docs = docs, tables.put(name, stage(spark, docs, sf_dir))
        tables.free(before)
    return docs
