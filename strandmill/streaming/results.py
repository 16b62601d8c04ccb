"""A stream's rows as a table in which each micro-batch is written exactly once: a batch that is run again replaces its own part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def write_batch(frame: DataFrame, place: str, batch: int) -> None:
    """Replaces the part of one batch."""
    frame.write.mode("overwrite").parquet(f"{place}/batch={batch}")


def write_batches(stream: DataFrame, place: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Starts the query; after a restart from its checkpoint the last batch may come again, and replaces what it had written."""
    return stream.writeStream.foreachBatch(lambda frame, batch: write_batch(frame, place, batch)).option("checkpointLocation", checkpoint).options(**options).start()


def latest(spark: SparkSession, place: str, keys: list[str]) -> DataFrame:
    """Of each key the row of its last batch: units that were run again count once."""
    rows = spark.read.parquet(place)
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "batch")
