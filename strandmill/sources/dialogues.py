"""Multi-session dialogues with questions, from JSON: samples, turns, questions, taxonomy.

The file is an array of objects with `conversation` (session_N, session_N_date_time, speakers) and `qa`. The session
keys vary, so a sample's conversation is read as a map of JSON texts and filtered by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.functions.text import strip
from strandmill.sources.conversations import CATEGORIES, category_label
from strandmill.sources.json_array import elements

_TURN = "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>"
_QA = "array<struct<question:string,answer:string,adversarial_answer:string,category:string,evidence:array<string>>>"


def session_number(key: Column) -> Column:
    """Numbered sessions by number, others last."""
    return F.coalesce(F.try_to_number(F.get(F.split(key, "_"), F.lit(1)), F.lit("9999999999")).cast("long"), F.lit(10**9))


def with_caption(caption: Column, text: Column) -> Column:
    """An image's caption before the text, where there is one."""
    return strip(F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("[Image: "), caption, F.lit("] "), F.coalesce(text, F.lit("")))).otherwise(F.coalesce(text, F.lit(""))))


def reference_answer(category: Column, answer: Column, adversarial: Column) -> Column:
    """Category 5 has the adversarial answer (or the text None), others the answer or nothing."""
    return F.when(category == 5, F.coalesce(adversarial.cast("string"), F.lit("None"))).otherwise(F.coalesce(answer.cast("string"), F.lit("")))


def load(spark: SparkSession, path: str, dataset: str = "locomo", keep: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """samples, turns, questions and taxonomy of a file that is an array of samples. Large files are cut into blocks for many tasks; a row holds one sample.

    keep(rows) may write rows and read them again: then the file is cut and its samples are parsed once, not by every plan that uses a table of it."""
    held = elements(spark, path, keep).select(F.col("pos").alias("sample_pos"), F.from_json("text", f"conversation map<string,string>, qa {_QA}", {"mode": "FAILFAST"}).alias("s"))
    rows = held.select("sample_pos", "s.conversation", "s.qa")
    return parse(spark, keep(rows) if keep is not None else rows, dataset)


def parse(spark: SparkSession, rows: DataFrame, dataset: str = "locomo") -> dict[str, DataFrame]:
    """samples, turns, questions and taxonomy. rows: sample_pos, conversation (the JSON text of each key), qa."""
    raw = rows.select("sample_pos", F.concat(F.lit(f"{dataset}:"), F.col("sample_pos").cast("string")).alias("sample_id"), F.col("conversation").alias("c"), "qa")
    keyed = raw.select("sample_id", "c", F.explode(F.map_filter("c", lambda k, v: F.startswith(k, F.lit("session_")) & ~F.endswith(k, F.lit("_date_time")))).alias("key", "session"))
    placed = keyed.select("sample_id", "key", session_number(F.col("key")).alias("n"), F.get(F.split("key", "_"), F.lit(1)).alias("session_id"), F.element_at("c", F.concat("key", F.lit("_date_time"))).alias("timestamp"), F.posexplode(F.from_json("session", _TURN)).alias("k", "t"))
    evidence = F.coalesce(F.nullif(F.col("t.dia_id"), F.lit("")), F.concat(F.lit("D"), "session_id", F.lit(":"), (F.col("k") + 1).cast("string")))
    turns = placed.select(
        "sample_id", evidence.alias("evidence_id"), F.concat("sample_id", F.lit(":turn:"), evidence).alias("turn_id"), F.col("t.speaker").alias("speaker"), with_caption(F.col("t.blip_caption"), F.col("t.text")).alias("text"), "session_id", "timestamp",
        (F.row_number().over(Window.partitionBy("sample_id").orderBy("n", "key", "k")) - 1).alias("turn_pos"),
    )
    asked = raw.select("sample_id", F.posexplode("qa").alias("question_pos", "q"))
    category = F.expr("try_cast(q.category as int)")
    questions = asked.select(
        "sample_id", F.concat("sample_id", F.lit(":"), F.col("question_pos").cast("string")).alias("question_id"), "question_pos", F.col("q.question").alias("question"),
        reference_answer(category, F.col("q.answer"), F.col("q.adversarial_answer")).alias("reference"), F.coalesce("q.evidence", F.array().cast("array<string>")).alias("evidence_ids"),
        F.when(category.isNull(), F.create_map().cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("question_type"), F.array(category_label(category)))).alias("labels"),
    )
    taxonomy = spark.createDataFrame([("question_type", v, k) for k, v in CATEGORIES.items()], "dimension string, value string, ordinal int")
    return {"samples": raw.select("sample_id", "sample_pos"), "turns": turns, "questions": questions, "taxonomy": taxonomy}
