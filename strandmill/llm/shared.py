"""Session helpers: the shared folder, tables that cut lineage, and bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a session in one process (tests) gets one of its own; a cluster has no folder to share then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not found:
        found = getattr(spark.sparkContext, "_strandmill_dir", None)
        if not found:
            found = spark.sparkContext._strandmill_dir = "file://" + tempfile.mkdtemp(prefix="strandmill-")
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends in a written table go when it ends."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


#: Folders of tables that were made since each open `scratch` began.
_scratch: list[set[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Operators' tables that are made inside go at its end; what is needed later has to be written before, with kept=True."""
    _scratch.append(set())
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop(spark, path)


class Tables:
    """Parquet tables in the shared folder: each cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str, kept: bool = False):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if _scratch and not kept:
            _scratch[-1].add(self.root)

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_cleaned(self.spark):
            frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._strandmill_path = path
        return out

    def free(self, frame: DataFrame | None) -> None:
        """Deletes a table that nothing reads any more."""
        if frame is not None and "_strandmill_path" in frame.__dict__:
            drop(self.spark, frame._strandmill_path)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def has_repeated_ids(docs: DataFrame, id_col: str) -> bool:
    return not docs.groupBy(F.col(id_col).cast("long").alias("i")).count().where("i IS NOT NULL AND count > 1").isEmpty()


def numbered(tables: Tables, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with a number for each distinct id and text, in the order of the ids, and (id, doc_id) to go back.

    Where no id is repeated the ids are the numbers and there is nothing to go back to. Otherwise the distinct pairs are
    sorted by ranges and counted, so any long may be an id and no id is a key of a task. Rows without an id are left out."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    if not has_repeated_ids(docs, id_col):
        return rows, None
    keyed = rows.withColumnRenamed("id", "doc_id").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    ranges = keyed.select("doc_id", "h").distinct().repartitionByRange(partitions_of(docs.sparkSession), "doc_id", "h")
    sorted_ = tables.put("pairs", ranges.sortWithinPartitions("doc_id", "h").withColumn("p", F.spark_partition_id()))
    before, at = [], 0
    for r in sorted_.groupBy("p").count().orderBy("p").collect():
        before.append((r["p"], at))
        at += r["count"]
    offsets = F.create_map(*(F.lit(x) for pair in before for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    place = F.row_number().over(Window.partitionBy("p").orderBy("doc_id", "h")) - 1
    numbers = tables.put("numbers", sorted_.select("doc_id", "h", (place + F.element_at(offsets, F.col("p"))).cast("long").alias("id")))
    tables.free(sorted_)
    return tables.put("numbered", keyed.join(numbers, ["doc_id", "h"]).select("id", "text")), numbers.select("id", "doc_id")


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, by alternating large and small stars.

    edges: u, v. Nothing is gathered on the driver but a count and a checksum for each round."""

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = tables.put("edges", edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = tables.put("edges", small)
        tables.free(now)
        now, last, before = after, before, mark(after)
        if before == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
