"""Selections and resume: which samples, turns, questions and units of work are in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def select_samples(samples: DataFrame, ids: Sequence[str] | None = None, limit: int | None = None, order: str = "sample_pos") -> DataFrame:
    """Samples in the list (all for an empty or missing one), then the first `limit` in order."""
    out = samples.where(F.col("sample_id").isin(list(ids))) if ids else samples
    return out.orderBy(order).limit(limit) if limit else out


def first_of_each(rows: DataFrame, by: str, order: str, limit: int | None) -> DataFrame:
    """The first `limit` rows of each group: turn limits, question limits."""
    if not limit:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= limit).drop("_n")


def select_questions(questions: DataFrame, ids: Sequence[str] | None = None, categories: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Questions in the list, then with a category among the values of any label dimension, then the first of each sample."""
    out = questions.where(F.col("question_id").isin(list(ids))) if ids else questions
    if categories:
        out = out.where(F.arrays_overlap(F.flatten(F.map_values("labels")), F.array(*map(F.lit, categories))))
    return first_of_each(out, "sample_id", "question_pos", limit)


def pending(units: DataFrame, done: DataFrame, keys: Sequence[str], prints: Sequence[str] = ("fingerprint", "execution_fingerprint")) -> DataFrame:
    """Units without a completed row of the same fingerprints."""
    finished = done.where("status = 'completed'").select(*keys, *prints)
    return units.join(finished, [*keys, *prints], "left_anti")


def stores_of(stores: DataFrame, samples: DataFrame) -> DataFrame:
    return stores.join(samples.select("sample_id").distinct(), "sample_id", "left_semi")


def failure(kind: Column, message: Column, question_id: str = "question_id", sample_id: str = "sample_id") -> Column:
    """An error of a question; any of them may be tried again."""
    return F.struct(F.lit("retrieve_qa").alias("stage"), F.col(sample_id).alias("sample_id"), F.col(question_id).alias("question_id"), kind.alias("type"), message.alias("message"), F.lit(True).alias("retryable"))


def failed_rows(questions: DataFrame, stores: DataFrame, question_id: str = "question_id", sample_id: str = "sample_id") -> DataFrame:
    """One failed row for each question whose sample has no store. The error names the columns question_id and sample_id, where these aren't the keys."""
    lost = questions.join(stores.select("sample_id").distinct(), "sample_id", "left_anti")
    # Fixed value: the message.
    error = failure(F.lit("FileNotFoundError"), F.concat(F.lit("No construction store available for sample '"), F.col(sample_id), F.lit("'")), question_id, sample_id)
    return lost.withColumn("status", F.lit("failed")).withColumn("prediction", F.lit("")).withColumn("errors", F.array(error))
