"""Engine entities from the table of conversations: samples, turns, records, questions with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Question categories and their labels.
CATEGORIES = {1: "multi_hop", 2: "temporal", 3: "open_domain", 4: "single_hop", 5: "adversarial"}


def category_label(category: Column) -> Column:
    """The label of a category; null for null, an error for an unknown category."""
    known = F.create_map(*(x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))))
    label = F.element_at(known, category.cast("int"))
    return F.when(category.isNull(), F.lit(None).cast("string")).when(label.isNull(), F.raise_error(F.concat(F.lit("unknown category "), category.cast("string")))).otherwise(label)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, turn_id, evidence_id, turn_pos, speaker, text, session_id, timestamp."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    sample = F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))
    return rows.select(
        sample.alias("sample_id"), F.concat(sample, F.lit(":turn:"), F.col("turn").cast("string")).alias("turn_id"),
        F.concat(F.lit("D1:"), (F.col("turn") + 1).cast("string")).alias("evidence_id"), F.col("turn").alias("turn_pos"),
        F.col("role").alias("speaker"), "text", F.lit("1").alias("session_id"), F.lit(None).cast("string").alias("timestamp"),
    )


def records(turns: DataFrame) -> DataFrame:
    """Turns as memory records: one for each turn, its text the content, its evidence id the reference."""
    return turns.select(
        "sample_id", F.col("turn_id").alias("record_id"), F.col("turn_pos").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("text", F.lit("")).alias("content"),
        "timestamp", "speaker", "session_id", F.array("evidence_id").alias("evidence_refs"), F.array().cast("array<string>").alias("keywords"),
    )


def questions(turns: DataFrame) -> DataFrame:
    """A user turn that an assistant turn follows is a question, the next turn its reference."""
    after = turns.where("speaker = 'assistant'").select("sample_id", (F.col("turn_pos") - 1).alias("turn_pos"), F.coalesce("text", F.lit("")).alias("reference"), F.col("turn_id").alias("evidence_turn"))
    asked = turns.where("speaker = 'user'").join(after, ["sample_id", "turn_pos"])
    return asked.select(
        "sample_id", F.concat("sample_id", F.lit(":"), F.col("turn_pos").cast("string")).alias("question_id"), F.col("turn_pos").alias("question_pos"),
        F.coalesce("text", F.lit("")).alias("question"), "reference", F.array("evidence_turn").alias("evidence_ids"),
        F.create_map(F.lit("question_type"), F.array(category_label(F.col("turn_pos") % 5 + 1))).alias("labels"),
    )
