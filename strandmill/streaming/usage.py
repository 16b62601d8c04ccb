"""Usage over time: tumbling, sliding and session windows, for batches and for streams alike.

On a stream give `late`, the watermark; windows then close when it has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", F.col("event_type").alias("source"), "value")


def _marked(rows: DataFrame, late: str | None) -> DataFrame:
    return rows.withWatermark("ts", late) if late else rows


def _summed(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("latency_ms"))


def tumbling(rows: DataFrame, length: str, late: str | None = None) -> DataFrame:
    out = _summed(_marked(rows, late).groupBy(F.window("ts", length).alias("w"), "source"))
    return out.select(F.col("w.start").alias("start"), "source", "calls", "latency_ms")


def sliding(rows: DataFrame, length: str, step: str, late: str | None = None) -> DataFrame:
    out = _summed(_marked(rows, late).groupBy(F.window("ts", length, step).alias("w"), "source"))
    return out.select(F.col("w.start").alias("start"), "source", "calls", "latency_ms")


def sessions(rows: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    out = _summed(_marked(rows, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id"))
    return out.select("user_id", F.col("w.start").alias("start"), "calls", "latency_ms")
