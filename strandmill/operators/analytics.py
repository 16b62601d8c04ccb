"""Analytical views over results: means, breakdowns, usage, comparison, traces, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def metric_means(results: DataFrame) -> DataFrame:
    """name, mean: over completed rows, a missing metric counting 0. results: status, metrics (map)."""
    # One pass: the key "" is in every completed row, so its count is their number.
    done = results.where("status = 'completed'").select(F.explode(F.map_concat("metrics", F.create_map(F.lit(""), F.lit(0.0)))).alias("name", "value"))
    total = done.groupBy("name").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("total"), F.count("*").alias("n"))
    rows = F.max(F.when(F.col("name") == "", F.col("n"))).over(Window.partitionBy())  # one row for each metric
    return total.withColumn("rows", rows).where("name <> ''").select("name", (F.col("total") / F.col("rows")).alias("mean"))


def breakdown(results: DataFrame) -> DataFrame:
    """dimension, label, n: over all rows, failed ones too. results: labels (map of arrays)."""
    return results.select(F.explode("labels").alias("dimension", "values")).select("dimension", F.explode("values").alias("label")).groupBy("dimension", "label").agg(F.count("*").alias("n"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("questions"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def usage_by_source(usage: DataFrame) -> DataFrame:
    """source, calls, total_tokens, latency_ms; nulls count 0, a missing source is `unknown`."""
    return usage.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("calls"), F.sum(F.coalesce("total_tokens", F.lit(0))).cast("long").alias("total_tokens"), F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("latency_ms"))


def usage_records(files: DataFrame | None, results: DataFrame) -> DataFrame:
    """Rows of the usage files if there is any file, even an empty one; else the usage inside the results."""
    if files is not None:
        return files
    return results.select(F.explode("usage").alias("u")).select("u.*")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two experiments side by side, by run and question; null keys are equal; of repeated keys the last row (by `pos`) counts."""
    keys = ["construction_run", "qa_run", "question_id"]

    def last(rows: DataFrame, side: str) -> DataFrame:
        once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pos")))).where("_n = 1")
        return once.select(*(F.col(k).alias(f"{k}_{side}") for k in keys), *(F.col(c).alias(f"{c}_{side}") for c in ("question", "reference", "prediction", "status", "metrics") if c in rows.columns), F.lit(True).alias(f"in_{side}"))

    left, right = last(a, "a"), last(b, "b")
    on = F.col("question_id_a") == F.col("question_id_b")  # the equal key to join by
    for k in keys[:2]:
        on = on & F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b"))
    both = left.join(right, on, "full_outer")
    pick = lambda c: F.when(F.col("in_a"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    rest = [f"{c}_{s}" for c in ("prediction", "status", "metrics") for s in "ab" if f"{c}_{s}" in both.columns]
    return both.select(*(pick(k).alias(k) for k in keys), *(F.coalesce(pick(c), F.lit("")).alias(c) for c in ("question", "reference")), *rest)


def compare_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.coalesce("construction_run", F.lit(-1)), F.coalesce("qa_run", F.lit(-1)), "question_id")


def result_order(rows: DataFrame) -> DataFrame:
    """Sample and question ids order as texts, so 10 comes before 2; runs by number."""
    runs = [c for c in ("construction_run", "qa_run") if c in rows.columns]
    return rows.orderBy(*runs, "sample_id", "question_id")


def trace(results: DataFrame, question_id: str | None, construction_run: int | None = None, qa_run: int | None = None) -> DataFrame:
    """The first row of the question, in the order of runs and rows; a question or run of None is no condition."""
    out = results if question_id is None else results.where(F.col("question_id") == question_id)
    if construction_run is not None:
        out = out.where(F.col("construction_run") == construction_run)
    if qa_run is not None:
        out = out.where(F.col("qa_run") == qa_run)
    return out.orderBy("construction_run", "qa_run", "pos").limit(1)


def timing(rows: DataFrame, by: str = "stage", value: str = "seconds") -> DataFrame:
    """count, total, min, max, avg of each stage."""
    return rows.groupBy(by).agg(F.count("*").alias("count"), F.sum(value).alias("total"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"))


def merge_timings(parts: DataFrame, by: str = "stage") -> DataFrame:
    """Partial summaries into one; parts without a count are skipped."""
    some = parts.where("count > 0")
    return some.groupBy(by).agg(F.sum("count").alias("count"), F.sum("total").alias("total"), F.min("min").alias("min"), F.max("max").alias("max")).withColumn("avg", F.col("total") / F.col("count"))


def errors(results: DataFrame) -> DataFrame:
    return results.select(F.explode("errors").alias("e")).select("e.*")
