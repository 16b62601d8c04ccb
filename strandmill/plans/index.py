"""Read-only views over written experiments."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators import analytics
from strandmill.sources.artifacts import STORE, Experiment, experiments


class Index:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, root

    def experiments(self) -> list[str]:
        return experiments(self.root)

    def manifest(self, name: str) -> dict[str, Any]:
        return Experiment(self.root, name).manifest_path.read_json()

    def results(self, name: str) -> DataFrame:
        """All runs' rows with construction_run and qa_run."""
        return Experiment(self.root, name).read(self.spark, "results")

    def overview(self, name: str) -> dict[str, Any]:
        manifest, rows = self.manifest(name), self.results(name)
        counts = analytics.status_counts(rows).first()
        groups: dict[str, dict[str, int]] = {}
        for r in analytics.breakdown(rows).orderBy("dimension", "label").collect():
            groups.setdefault(r["dimension"], {})[r["label"]] = r["n"]
        return {
            "experiment_id": name, "status": manifest["status"], "fingerprint": manifest["fingerprint"], "taxonomy": manifest["taxonomy"]["dimensions"], "taxonomy_breakdown": groups, "questions": counts["questions"], "failed_questions": counts["failed"],
            "metrics": {r["name"]: r["mean"] for r in analytics.metric_means(rows).collect()}, "usage": self.usage(name),
        }

    def errors(self, name: str) -> DataFrame:
        """Of samples that could not be built, and of questions."""
        held, columns = Experiment(self.root, name), ["stage", "sample_id", "question_id", "type", "message", "retryable"]
        own = analytics.errors(self.results(name)).select(*columns)
        return own.unionByName(held.read(self.spark, "construction_errors").select(*columns)) if held.runs("construction_errors") else own

    def usage(self, name: str) -> dict[str, dict[str, float]]:
        """By source, over construction and evaluation."""
        held = Experiment(self.root, name)
        files = [held.read(self.spark, t).drop("question_id", "sample_id", "construction_run", "qa_run") for t in ("usage", "construction_usage") if held.runs(t)]
        rows = analytics.usage_records(files[0] if len(files) == 1 else files[0].unionByName(files[1]) if files else None, self.results(name))
        return {r["source"]: {"calls": r["calls"], "total_tokens": r["total_tokens"], "latency_ms": r["latency_ms"]} for r in analytics.usage_by_source(rows).collect()}

    def compare(self, a: str, b: str) -> DataFrame:
        return analytics.compare_order(analytics.compare(self.results(a), self.results(b)))

    def trace(self, name: str, question_id: str, construction_run: int | None = None, qa_run: int | None = None) -> dict[str, Any]:
        """The first matching result with its stages; KeyError if there is none."""
        found = analytics.trace(self.results(name), question_id, construction_run, qa_run).first()
        if found is None:
            raise KeyError(f"no question {question_id} in experiment {name}")
        steps = Experiment(self.root, name).read(self.spark, "traces", found["construction_run"], found["qa_run"]).where(F.col("question_id") == question_id)
        stages = steps.groupBy("stage_index", "adapter", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "record_id", "score"))).alias("ranking"), F.first("latency_ms").alias("latency_ms")).orderBy("stage_index")
        return found.asDict(recursive=True) | {"stages": [r.asDict(recursive=True) for r in stages.collect()]}

    def graph(self, name: str, construction_run: int, sample_id: str) -> dict[str, DataFrame]:
        """All tables of one store."""
        held = Experiment(self.root, name)
        return {t: held.read(self.spark, t, construction_run).where(F.col("sample_id") == sample_id) for t in STORE}

    def timings(self, name: str) -> DataFrame:
        """Seconds of note building by stage, over all construction runs; without such runs there are none."""
        held = Experiment(self.root, name)
        if not held.runs("timings"):
            return self.spark.createDataFrame([], "stage string, count long, total double, min double, max double, avg double")
        return analytics.merge_timings(held.read(self.spark, "timings"))

    def in_order(self, name: str) -> DataFrame:
        """Results by sample and question id as texts, run by run."""
        return analytics.result_order(self.results(name))
