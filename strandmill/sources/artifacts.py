"""Tables of an experiment: Parquet by run, with small control files as JSON, on storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from strandmill.sources.files import Place

VERSION = "experiment/v1"
STORE = ("records", "nodes", "edges", "layers", "stores")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing file has no rows, blank lines are skipped."""
    if not Place(path, spark).exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; a session in one process (tests) without that setting gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandmill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Experiment:
    """Places of an experiment's tables. The root is a path of any file system that Spark reaches; on a cluster it has to be shared."""

    def __init__(self, root: str | Path | Place, experiment_id: str):
        self.root = Place(root) / experiment_id

    def table(self, name: str, construction_run: int | None = None, qa_run: int | None = None) -> Place:
        runs = [f"construction_run={construction_run}"] * (construction_run is not None) + [f"qa_run={qa_run}"] * (qa_run is not None)
        return Place("/".join([str(self.root), "tables", name, *runs]), self.root.spark)

    def has(self, name: str, *runs: int) -> bool:
        return self.table(name, *runs).exists()

    def write(self, name: str, frame: DataFrame, *runs: int) -> None:
        frame.write.mode("overwrite").parquet(str(self.table(name, *runs)))

    def read(self, spark: SparkSession, name: str, *runs: int) -> DataFrame:
        """One run's rows, or all runs' with their run columns."""
        return self.buckets(spark, name, *runs).drop("bucket", "slot")

    def buckets(self, spark: SparkSession, name: str, *runs: int) -> DataFrame:
        """The same rows, with the bucket that each was written in, or the slot by which they are ordered, if the table has these."""
        return spark.read.parquet(str(self.table(name, *runs)))

    def runs(self, name: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.table(name).children() if n.startswith("construction_run="))

    @property
    def manifest_path(self) -> Place:
        return self.root / "manifest.json"


def experiments(root: str | Path) -> list[str]:
    base = Place(root)
    return [name for name in base.children() if (base / name / "manifest.json").exists()]


def write_store(place: str, tables: dict[str, DataFrame]) -> None:
    """The tables of memory stores: records, nodes, edges (also to ends that don't exist) and layers by sample, and the header `stores` with
    schema_version, private_refs and metadata, which is written last: a store without a header isn't there."""
    if missing := [name for name in STORE if name not in tables]:
        raise ValueError(f"a store has {', '.join(missing)} too")
    for name in STORE:
        tables[name].write.mode("overwrite").parquet(f"{place}/{name}")


def read_store(spark: SparkSession, place: str) -> dict[str, DataFrame]:
    """The tables of written stores; an AnalysisException if there is no header."""
    header = spark.read.parquet(f"{place}/stores")
    return {name: spark.read.parquet(f"{place}/{name}") for name in STORE[:-1]} | {"stores": header}
