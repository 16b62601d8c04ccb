"""Runs an experiment file: load, construct, evaluate, persist. Runs are a dimension: notes of all construction runs are built in one plan, and questions of
all runs are answered together, under keys that name their runs. Runs of questions over one store share their answers where no model is asked.

Errors of samples and questions are rows, not exceptions: a sample that fails has a failed status and no store, and its questions are failed rows. A finished unit (a sample's store, a question's result) with the same
fingerprints is kept on resume: what is left to do is an anti join. Questions are answered in buckets by the slots of their samples, some buckets at a time (a wave), with all runs of questions over one store
together; records and index are written in the order of slots, so a wave reads those of its samples only. A bucket's results are
moved to their place when they are written whole, so a run that is lost goes on with the buckets that are not there.
All tables are on the storage of the artifact root; what a wave needs in between is in its `work` folder, which goes with it.
"""

from __future__ import annotations

import hashlib
import subprocess
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from operator import or_
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import encoders
from strandmill.functions.metrics import metric_map
from strandmill.functions.providers import client, completed, with_retries
from strandmill.functions.text import strip
from strandmill.operators import analytics, construct, context, graph, selection
from strandmill.operators.ranking import Corpus
from strandmill.plans.config import fingerprint
from strandmill.plans.registry import catalog
from strandmill.plans.stages import Stage, retrieve, traces
from strandmill.sources.artifacts import STORE, VERSION, Experiment
from strandmill.sources.conversations import records as turn_records
from strandmill.sources.files import Place
from strandmill.sources.indexes import SLOTS, TextIndex, slot, within

QUESTIONS_A_BUCKET = 4096
BUCKETS_A_WAVE = 32
BUCKETS = 32  # of one run at most: plans, moves and commits of a bucket and a wave don't grow with the questions
RUN = ["construction_run", "qa_run"]

USAGE = "struct<phase:string,component:string,provider:string,model:string,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,source:string,latency_ms:double>"
ERROR = "struct<stage:string,sample_id:string,question_id:string,type:string,message:string,retryable:boolean>"


STORE_VERSION = "store/v1"
PARTS = {
    "nodes": "sample_id string, node_id string, type string, text string, layer string, properties struct<context:string,keywords:array<string>>, pos int",
    "edges": "sample_id string, edge_id string, source_id string, target_id string, type string, link_pos int",
    "layers": "sample_id string, name string, node_ids array<string>, edge_ids array<string>",
}


def _kind_and_message(why: Column) -> tuple[Column, Column]:
    """Type and message of an error that is told as `type: message`."""
    return F.substring_index(why, ":", 1).alias("type"), F.ltrim(F.substring(why, F.instr(why, ":") + 1, F.length(why))).alias("message")


@dataclass(frozen=True)
class Outcome:
    exit_code: int
    status: str
    root: Place


def code_fingerprint() -> str:
    """The package's sources, the git revision and what differs from it."""
    base = Path(__file__).resolve().parent.parent
    parts = [p.read_bytes() for p in sorted(base.rglob("*.py")) if "llm" not in p.relative_to(base).parts]
    git = lambda *words: subprocess.run(["git", "-C", str(base), *words], capture_output=True, check=False).stdout
    return hashlib.sha256(b"\0".join([git("rev-parse", "HEAD").strip(), git("diff", "--binary", "HEAD", "--", "."), *parts])).hexdigest()


def used(component: str, llm: dict[str, Any], reply: str = "_r") -> Column:
    """The usage row of a completion."""
    counts = (F.col(f"{reply}.{c}").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "source", "latency_ms"))
    return F.struct(F.lit("retrieve_qa").alias("phase"), F.lit(component).alias("component"), F.lit(llm["provider"]).alias("provider"), F.lit(llm["model"]).alias("model"), *counts).cast(USAGE)


class Work:
    """Tables that are needed for a while: each is written once and read again, and all go together."""

    def __init__(self, place: Place):
        self.place, self.count = place / uuid.uuid4().hex, 0

    def put(self, name: str, frame: DataFrame, by: Iterable[str] = ()) -> DataFrame:
        self.count += 1
        path = self.place / f"{name}-{self.count}"
        frame.write.partitionBy(*by).parquet(str(path))
        out = frame.sparkSession.read.schema(frame.schema).parquet(str(path))
        out._place = path
        return out

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_: Any) -> None:
        self.place.delete()


class Runner:
    def __init__(self, spark: SparkSession, tree: dict[str, Any], encode=None, pair_score=None):
        """encode, pair_score: functions of text columns for embedding and cross_encoder stages; without them a stage's params name a model of sentence_transformers."""
        self.spark, self.tree, self.encode, self.pair_score = spark, tree, encode, pair_score
        self.print, self.code = fingerprint(tree), code_fingerprint()
        self.out = Experiment(tree["runtime"]["artifact_root"], tree["experiment"]["id"])

    # ---- whole

    def run(self) -> Outcome:
        data = self.tree["pipeline"]["dataset"]
        place = Place(data["path"], self.spark)
        if not place.exists():
            raise FileNotFoundError(f"no such dataset: {data['path']}")
        (self.out.root / "work").delete()  # of a run that was lost
        self.sha = place.sha256()
        with self._work() as work:
            # Every part of a run reads the dataset; from a table, it is parsed once.
            self.data = catalog()["dataset"].get(data["adapter"])(self.spark, str(place), keep=lambda rows: work.put("dataset", rows))
            return self._parts()

    def _parts(self) -> Outcome:
        stages = self.tree["pipeline"]["stages"]
        source = self.out
        if "construction" not in stages:
            source = self._external()
        self._manifest("running")
        partial = self._construct() if "construction" in stages else False
        if "retrieve_qa" in stages:
            partial |= self._evaluate(source)
        fatal = partial and self.tree["runtime"]["on_error"] == "stop"
        status = "failed" if fatal else "partial" if partial else "completed"
        self._manifest(status)
        return Outcome(1 if fatal else 2 if partial else 0, status, self.out.root)

    def _work(self) -> Work:
        return Work(self.out.root / "work")

    def _manifest(self, status: str) -> None:
        taxonomy = {}
        for r in self.data["taxonomy"].orderBy("dimension", "ordinal").collect():  # five rows
            taxonomy.setdefault(r["dimension"], []).append(r["value"])
        self.out.manifest_path.write_json({
            "schema_version": VERSION, "experiment_id": self.tree["experiment"]["id"], "fingerprint": self.print, "execution_fingerprint": self.code, "status": status, "updated_at": datetime.now(UTC).isoformat(),
            "dataset": self.tree["pipeline"]["dataset"] | {"sha256": self.sha}, "config": self.tree, "taxonomy": {"dimensions": [{"name": k, "values": v} for k, v in taxonomy.items()]},
        })

    # ---- construction

    def _construct(self) -> bool:
        """Whether a sample failed."""
        part = self.tree["pipeline"]["construction"]
        chosen, runs = part["selection"], range(part["runs"])
        samples = selection.select_samples(self.data["samples"], chosen["sample_ids"], chosen["sample_limit"])
        prints = {"fingerprint": F.lit(self.print), "execution_fingerprint": F.lit(self.code)}
        units = samples.select("sample_id", F.explode(F.array(*map(F.lit, runs))).alias("construction_run")).withColumns(prints)
        with self._work() as work:
            kept = [r for r in self.out.runs("status") if r in runs] if self.tree["runtime"]["resume"] else []
            if kept:
                units = selection.pending(units, self.out.read(self.spark, "status").where(F.col("construction_run").isin(kept)), ["construction_run", "sample_id"])
            units = work.put("units", units)
            todo = sorted(r["construction_run"] for r in units.select("construction_run").distinct().collect())
            # Every run reads the turns; from a table, the file is parsed once.
            turns = work.put("turns", self.data["turns"].join(units.select("sample_id").distinct(), "sample_id", "left_semi")) if todo else self.data["turns"]
            turns = turns.join(units.select("sample_id", "construction_run"), "sample_id")
            if chosen["turn_limit"]:
                turns = selection.first_of_each(turns.withColumn("_unit", F.struct("construction_run", "sample_id")), "_unit", "turn_pos", chosen["turn_limit"]).drop("_unit")
            built = self._notes(part, turns, work) if part["adapter"] != "turn_rag" and todo else None
            for run in todo:
                of_run = lambda frame, run=run: frame.where(F.col("construction_run") == run).drop("construction_run")
                before = {name: self.out.read(self.spark, name, run) for name in (*STORE, "status")} if run in kept else None
                self._store_run(part, run, of_run(units), of_run(turns), built and of_run(built), before, work)
        return any([self._construction_summary(run) for run in runs])

    def _store_run(self, part: dict[str, Any], run: int, units: DataFrame, turns: DataFrame, built: DataFrame | None, before: dict[str, DataFrame] | None, work: Work) -> None:
        """Writes a run's tables, with the rows of units that are kept, and its index."""
        stores, failed = self._stores(part, turns, built)
        state = units.join(failed, "sample_id", "left")
        fine = F.col("error").isNull()
        stores["stores"] = state.where(fine).select("sample_id", F.lit(STORE_VERSION).alias("schema_version"), F.create_map().cast("map<string,string>").alias("private_refs"), F.create_map(F.lit("method"), F.lit(part["adapter"])).alias("metadata"))
        stores["status"] = state.select("sample_id", "fingerprint", "execution_fingerprint", F.when(fine, "completed").otherwise("failed").alias("status"), "error")
        new = {}
        for name, frame in stores.items():
            old = before[name].join(units.select("sample_id"), "sample_id", "left_anti") if before else None
            frame = frame.unionByName(old, allowMissingColumns=True) if before else frame
            if name == "records":
                frame = frame.withColumn("slot", slot("sample_id")).repartitionByRange("slot", "record_id").sortWithinPartitions("slot", "record_id")
            new[name] = work.put(name, frame)
        # Samples that were not there before are one more batch of the index; if any was, the run's index is made anew.
        index, added = self.index(self.out, run), new["records"].join(units.select("sample_id"), "sample_id", "left_semi")
        if before is None or not before["records"].join(units.select("sample_id"), "sample_id", "left_semi").isEmpty() or not index.batches():
            index.place.delete()
            added = new["records"]
        index.append(added.select("sample_id", "record_id", "text"))
        for name, frame in new.items():
            frame._place.move(self.out.table(name, run))
        new = {name: self.out.read(self.spark, name, run) for name in ("status", "records")}
        lost = new["status"].where("error IS NOT NULL").select(F.lit("construction").alias("stage"), "sample_id", F.lit(None).cast("string").alias("question_id"), *_kind_and_message(F.col("error")), F.lit(True).alias("retryable"))
        self.out.write("construction_errors", lost, run)
        self.out.write("construction_usage", new["records"].where("usage IS NOT NULL").select("sample_id", F.explode("usage").alias("u")).select("sample_id", "u.*"), run)
        if built is not None:
            spent = built.select(F.explode(F.arrays_zip("stages", "seconds")).alias("t")).select(F.col("t.stages").alias("stage"), F.col("t.seconds").alias("seconds"))
            self.out.write("timings", analytics.timing(spent), run)

    def index(self, held: Experiment, run: int) -> TextIndex:
        """The postings of a run's records, which every bm25 stage over whole samples reads."""
        return TextIndex(held.root / "index" / f"run_{run:03d}")

    def _construction_summary(self, run: int) -> bool:
        """Writes a run's figures; whether a sample failed."""
        counts = {r["status"]: r["count"] for r in self.out.read(self.spark, "status", run).groupBy("status").count().collect()} if self.out.has("status", run) else {}
        broken = counts.get("failed", 0)
        (self.out.root / "construction" / f"run_{run:03d}" / "status.json").write_json({"status": "partial" if broken else "completed", "fingerprint": self.print, "execution_fingerprint": self.code, "selected_samples": sum(counts.values()), "completed_samples": counts.get("completed", 0), "failed_samples": broken})
        return broken > 0

    def _notes(self, part: dict[str, Any], turns: DataFrame, work: Work) -> DataFrame:
        """Notes of all samples of all runs, in one plan; from a table, as the model is asked once."""
        llm, params = part["llm"], part["params"]
        responses = llm["params"].get("responses", ())
        # Each sample starts the script anew, as each has a model of its own.
        make = (lambda _: construct.scripted(responses)) if llm["provider"] == "fake" else (lambda _, ask=with_retries(client(llm)): (lambda prompt, heat: ask(prompt, heat)["text"]))
        return work.put("notes", construct.build_notes(turns, make, mode=params.get("keyword_pruning_mode", "nltk"), evolution_threshold=int(params.get("evolution_threshold", 100))))

    def _stores(self, part: dict[str, Any], turns: DataFrame, built: DataFrame | None) -> tuple[dict[str, DataFrame], DataFrame]:
        """records, nodes, edges and layers of each sample, and (sample_id, error) of those that failed."""
        nothing = lambda schema: self.spark.createDataFrame([], schema)
        if built is None:
            held = turn_records(turns)
            none = F.array().cast("array<string>")
            records = held.select("sample_id", "record_id", "pos", "text", "content", "timestamp", "speaker", "session_id", "evidence_refs", "keywords", F.lit("").alias("context"), none.alias("tags"), none.alias("links"), F.lit(None).cast(f"array<{USAGE}>").alias("usage"))
            return {"records": records} | {name: nothing(schema) for name, schema in PARTS.items()}, nothing("sample_id string, error string")
        llm = part["llm"]
        notes = built.where("error IS NULL").drop("error", "stages", "seconds")
        one = lambda x: F.struct(F.lit("construction").alias("phase"), F.lit("note_model").alias("component"), F.lit(llm["provider"]).alias("provider"), F.lit(llm["model"]).alias("model"), x["prompt_tokens"].alias("prompt_tokens"), x["completion_tokens"].alias("completion_tokens"), (x["prompt_tokens"] + x["completion_tokens"]).alias("total_tokens"), F.lit("estimated").alias("source"), F.lit(None).cast("double").alias("latency_ms"))
        records = construct.enriched(notes, turns).withColumn("content", F.col("text")).withColumn("usage", F.transform(F.arrays_zip("prompt_tokens", "completion_tokens"), one).cast(f"array<{USAGE}>"))
        edges = graph.edges(notes.select("sample_id", "record_id", "pos", F.posexplode("links").alias("link_pos", "target_id")))
        tables = {"records": records.drop("prompt_tokens", "completion_tokens", "completions", "failures"), "nodes": graph.nodes(notes), "edges": edges, "layers": graph.layers(notes, edges)}
        return tables, built.where("error IS NOT NULL").select("sample_id", "error")

    def _external(self) -> Experiment:
        """Another experiment's stores: complete, of the same data, with the runs asked for."""
        wanted = self.tree["pipeline"]["retrieve_qa"]["memory_source"]
        other = Experiment(self.tree["runtime"]["artifact_root"], wanted["experiment_id"])
        manifest = other.manifest_path.read_json()
        if manifest["dataset"]["sha256"] != self.sha:
            raise ValueError("dataset fingerprint mismatch between this experiment and its memory source")
        if manifest["status"] != "completed":
            raise ValueError(f"memory source {wanted['experiment_id']} is not completed")
        held = other.runs("status")
        self.source_runs = held if wanted["construction_runs"] == "all" else [r for r in held if r in wanted["construction_runs"]]
        for run in self.source_runs:
            if not other.read(self.spark, "status", run).where((F.col("status") != "completed") | (F.col("fingerprint") != manifest["fingerprint"])).isEmpty():
                raise ValueError(f"memory source {wanted['experiment_id']} run {run} is not completed")
        if not self.source_runs:
            raise FileNotFoundError(f"memory source {wanted['experiment_id']} has none of the construction runs")
        return other

    # ---- evaluation

    def _stages(self, part: dict[str, Any], work: Work) -> list[Stage]:
        out = []
        for s in part["retrieval"]["stages"]:
            params = dict(s["params"])
            if s["adapter"].startswith("embedding"):
                params["encode"] = self.encode or encoders.sentence_encoder(**{k: params[k] for k in ("model",) if k in params})
            if s["adapter"] == "cross_encoder":
                params["score"] = self.pair_score or encoders.cross_encoder(**{k: params[k] for k in ("model",) if k in params})
            out.append(Stage(s["adapter"], s["top_k"], s["query"], params, self._rewriter(s["llm"], work) if s["llm"] else None))
        return out

    def _rewriter(self, llm: dict[str, Any], work: Work):
        def rewrite(asked: DataFrame, template: str) -> DataFrame:
            failed = F.col("_error") if "_error" in asked.columns else F.lit(None).cast("string")
            reply = completed(llm, F.when(failed.isNull(), F.replace(F.lit(template), F.lit("{question}"), F.col("query"))))
            out = asked.withColumn("_r", reply)
            before = F.col("_usage") if "_usage" in asked.columns else F.array().cast(f"array<{USAGE}>")
            out = out.withColumns({"query": strip(F.col("_r.text")), "_usage": F.array_append(before, used("retrieval:query_transform", llm)), "_error": F.coalesce(failed, F.col("_r.error"))}).drop("_r")
            return work.put("rewritten", out)  # the model is asked once, though results and traces read it

        return rewrite

    def _evaluate(self, source: Experiment) -> bool:
        """Whether a question failed."""
        part = self.tree["pipeline"]["retrieve_qa"]
        chosen = part["selection"]
        samples = selection.select_samples(self.data["samples"], chosen["sample_ids"], chosen["sample_limit"])
        questions = selection.select_questions(self.data["questions"].join(samples.select("sample_id"), "sample_id", "left_semi"), chosen["question_ids"], chosen["categories"], chosen["question_limit"])
        runs = [(b, r) for b in getattr(self, "source_runs", None) or source.runs("status") for r in range(part["runs"])]
        layout, resume = self.out.root / "retrieve_qa" / "layout.json", self.tree["runtime"]["resume"] and self.out.has("results")
        resume = resume and layout.read_json().get("by") == "slot"  # buckets by question ids were of other code, whose results are not kept
        if not resume:
            for name in ("results", "traces", "stage_timings"):
                self.out.table(name).delete()
            (self.out.root / "retrieve_qa").delete()
        with self._work() as work:
            # Every wave reads the questions; from a table, a plan does not hold the parsing of the file each time.
            questions = work.put("questions", questions)
            buckets = layout.read_json()["buckets"] if resume else max(1, min(BUCKETS, -(-questions.count() // QUESTIONS_A_BUCKET)))
            layout.write_json({"buckets": buckets, "by": "slot"})
            place = F.explode(F.array(*(F.struct(F.lit(b).alias("construction_run"), F.lit(r).alias("qa_run")) for b, r in runs))).alias("_run")
            units = questions.select("*", F.floor(slot("sample_id").cast("long") * buckets / SLOTS).cast("int").alias("bucket"), place).select("*", "_run.*").drop("_run")
            units = units.withColumns({"fingerprint": F.lit(self.print), "execution_fingerprint": F.lit(self.code)})
            before = {name: self.out.buckets(self.spark, name) for name in ("results", "traces")} if resume else {}
            todo = selection.pending(units, before["results"], [*RUN, "question_id"]) if resume else units
            todo = work.put("todo", todo.hint("rebalance", *RUN, "bucket"), [*RUN, "bucket"])
            counts = {tuple(r)[:3]: r["count"] for r in todo.groupBy(*RUN, "bucket").count().collect()}  # one row for each bucket
            seconds: dict[tuple, float] = {}
            names = sorted(counts, key=lambda n: (n[0], n[2], n[1]))
            for at in range(0, len(names), BUCKETS_A_WAVE):
                self._wave(part, source, todo, names[at : at + BUCKETS_A_WAVE], sum(counts[n] for n in names[at : at + BUCKETS_A_WAVE]), before, seconds, buckets)
        return any([self._summary(*run, seconds) for run in runs])

    def _wave(self, part: dict[str, Any], source: Experiment, todo: DataFrame, units: list[tuple[int, int, int]], n: int, before: dict[str, DataFrame], seconds: dict[tuple, float], buckets: int) -> None:
        """Answers the questions of some buckets and commits each of these: traces are moved first, results last."""
        wanted = F.broadcast(self.spark.createDataFrame(units, "construction_run int, qa_run int, bucket int"))
        built = sorted({b for b, _, _ in units})
        span = {b: (min(k for c, _, k in units if c == b), max(k for c, _, k in units if c == b)) for b in built}
        slots = {b: (-(-low * SLOTS // buckets), -(-(high + 1) * SLOTS // buckets)) for b, (low, high) in span.items()}
        # Folders of other buckets are not read: a join alone would read them all.
        near = reduce(or_, ((F.col("construction_run") == b) & F.col("bucket").between(*span[b]) for b in built))
        with self._work() as work:
            # Keys name the runs: questions by both, samples and records by the construction run.
            asked = todo.where(near).join(wanted, [*RUN, "bucket"]).withColumns({"asked_id": F.col("question_id"), "of_sample": F.col("sample_id")})
            asked = work.put("asked", asked.withColumns({"question_id": F.concat_ws("/", *RUN, "question_id"), "sample_id": F.concat_ws("/", "construction_run", "sample_id")}))

            def keyed(frame: DataFrame, run: int) -> DataFrame:
                name = lambda x: F.concat(F.lit(f"{run}/"), x)
                out = frame.withColumns({c: name(F.col(c)) for c in ("sample_id", "record_id") if c in frame.columns})
                return out.withColumn("links", F.transform("links", name)) if "links" in frame.columns else out

            stored = {b: source.buckets(self.spark, "records", b) for b in built}
            every = [keyed(within(x, slots[b], "slot" if "slot" in x.columns else None, "sample_id").drop("slot"), b) for b, x in stored.items()]
            records = every[0]
            for x in every[1:]:
                records = records.unionByName(x, allowMissingColumns=True)
            indexes = {b: self.index(source, b) for b in built}
            corpus = None
            if all(x.batches() for x in indexes.values()):
                held = [(b, x.corpus(self.spark, slots[b])) for b, x in indexes.items()]
                parts = {name: [keyed(getattr(c, name), b) for b, c in held] for name in ("postings", "terms", "scopes", "documents")}
                for name, frames in parts.items():
                    for x in frames[1:]:
                        frames[0] = frames[0].unionByName(x)
                corpus = Corpus(["sample_id"], *(parts[name][0] for name in ("postings", "terms", "scopes", "documents")))
            spent: list[tuple[int, str, float]] = []
            fresh, trace = self._answers(part, asked, records, work, corpus, spent, keyed=True)
            fresh = work.put("answers", fresh.withColumns({"fingerprint": F.lit(self.print), "execution_fingerprint": F.lit(self.code)}))  # the model is asked once
            # A trace that runs share is each one's.
            trace = trace.join(fresh.where("status = 'completed'").select(*RUN, "bucket", "question_id"), [c for c in (*RUN, "question_id") if c in trace.columns])
            # A stage answers all questions of a wave at once; each has the same part of its time.
            each = F.element_at(F.create_map(*(F.lit(x) for k, _, s in spent for x in (k, 1000 * s / n))), F.col("stage_index")) if spent else F.lit(None).cast("double")
            tables = {"traces": trace.withColumn("latency_ms", each), "results": fresh}
            for name, frame in tables.items():
                if before:
                    old = before[name].where(near).join(wanted, [*RUN, "bucket"], "left_semi").join(asked.select(*RUN, F.col("asked_id").alias("question_id")), [*RUN, "question_id"], "left_anti")
                    frame = frame.unionByName(old, allowMissingColumns=True)
                # A bucket's rows come together before they are written, or each task would write a file for each bucket.
                frame.hint("rebalance", *RUN, "bucket").write.partitionBy(*RUN, "bucket").parquet(str(work.place / "done" / name))
            figures = {tuple(r)[:3]: r for r in fresh.groupBy(*RUN, "bucket").agg(F.count("*").alias("answered"), F.count_if(F.col("status") == "failed").alias("failed")).collect()}
            for unit in units:
                folder = "/".join(f"{c}={v}" for c, v in zip((*RUN, "bucket"), unit, strict=True))
                for name in tables:
                    done, target = (Place(f"{x}/{folder}", self.spark) for x in (work.place / "done" / name, self.out.table(name)))
                    if not done.exists():  # no question of the bucket has a trace
                        tables[name].drop(*RUN, "bucket").limit(0).write.parquet(str(done))
                    done.move(target)
                Place(f"{self.out.root / 'retrieve_qa' / 'commits'}/{folder}.json", self.spark).write_json({"answered": figures[unit]["answered"], "failed": figures[unit]["failed"], "fingerprint": self.print, "execution_fingerprint": self.code})
            for b, r in {u[:2] for u in units}:
                for k, name, s in spent:
                    seconds[b, r, k, name] = seconds.get((b, r, k, name), 0.0) + s

    def _answers(self, part: dict[str, Any], questions: DataFrame, records: DataFrame, work: Work, corpus: Corpus | None = None, spent: list | None = None, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
        """Results of the questions, and the trace of their stages.

        keyed: question_id, sample_id and the ids of records name their runs, and asked_id and of_sample are the plain ones, which the rows get back. spent: gets each stage's seconds.
        Where no model is asked, a question of several runs over one store is answered once, and its trace has no qa_run."""
        shown_id, shown_sample = ("asked_id", "of_sample") if keyed else ("question_id", "sample_id")
        shared = keyed and part["qa"]["adapter"] != "robust" and not any(s["llm"] for s in part["retrieval"]["stages"])
        if shared:
            once = questions.groupBy("construction_run", "asked_id").agg(F.min("qa_run").alias("qa_run"), F.collect_list("qa_run").alias("_runs"))
            questions = work.put("once", questions.join(once, [*RUN, "asked_id"]))
        held = records.select("sample_id").distinct()
        lost = selection.failed_rows(questions, held, shown_id, shown_sample)
        able = questions.join(held, "sample_id", "left_semi")

        def keep(found: DataFrame, k: int) -> DataFrame:
            """A stage's result as a table: candidates of the questions, which the next stage, the trace and the answers read."""
            began = time.perf_counter()
            out = work.put(f"stage{k}", found)
            if spent is not None:
                spent.append((k, stages[k].adapter, time.perf_counter() - began))
            return out

        stages = self._stages(part, work)
        plan = retrieve(able, records.select("sample_id", "record_id", "pos", "text"), stages, keep, corpus)
        items = plan.candidates
        notes = part["context"]["adapter"] == "amem"
        if notes:
            items = graph.expand(items, records.select("sample_id", "record_id", F.posexplode("links").alias("link_pos", "target_id")), records)
            line = context.graph_lines(F.col("timestamp"), F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("text")), F.col("context"), F.col("keywords"), F.col("tags"))
        else:
            line = context.line(part["context"]["fields"])
        shown = context.joined(items.select("question_id", "record_id", "rank").join(records, "record_id"), line)
        rows = able.join(shown, "question_id", "left").withColumn("context_text", F.coalesce("context_text", F.lit("")))
        if "_usage" in plan.asked.columns:
            rows = rows.join(plan.asked.select("question_id", F.col("_usage").alias("usage"), F.col("_error").alias("_before")), "question_id")
        else:
            rows = rows.withColumns({"usage": F.array().cast(f"array<{USAGE}>"), "_before": F.lit(None).cast("string")})
        qa = part["qa"]
        if qa["adapter"] == "robust":
            label = F.col("labels")["question_type"][0]
            prompt = context.qa_prompt(F.col(shown_id), F.col("question"), F.col("reference"), label, F.col("context_text"), self.tree["runtime"]["seed"])
            rows = rows.withColumn("_r", completed(qa["llm"], F.when(F.col("_before").isNull(), prompt), context.qa_temperature(label, float(qa["params"].get("adversarial_temperature", 0.5)))))
            rows = rows.withColumn("prediction", strip(F.col("_r.text"))).withColumn("_why", F.col("_r.error")).withColumn("usage", F.array_append("usage", used("qa", qa["llm"])))
        else:
            fails = F.lit(False)
            if qa["adapter"] == "failing":
                ids = qa["params"].get("question_ids")
                fails = F.col(shown_id).isin(list(ids)) if ids else F.lit(True)
            rows = rows.withColumn("prediction", context.extractive(F.col("context_text"))).withColumn("_why", F.when(fails, "RuntimeError: intentional QA failure"))
        rows = rows.withColumn("_why", F.coalesce("_before", "_why"))
        bad = F.col("_why").isNotNull()
        error = selection.failure(*_kind_and_message(F.col("_why")), shown_id, shown_sample)
        scored = metric_map([m["adapter"] for m in part["metrics"]], F.col("prediction"), F.col("reference"))
        no_ids, no_usage, no_errors = F.array().cast("array<string>"), F.array().cast(f"array<{USAGE}>"), F.array().cast(f"array<{ERROR}>")
        found = F.coalesce("item_ids", no_ids)
        plain = F.transform(found, lambda x: F.substr(x, F.instr(x, "/") + 1)) if keyed else found
        ids = [F.col(shown_id).alias("question_id"), F.col(shown_sample).alias("sample_id"), *([*RUN, "bucket"] if keyed else []), *(["_runs"] if shared else [])]
        rows = rows.select(
            *ids, F.when(bad, "failed").otherwise("completed").alias("status"), "question", "reference", F.when(bad, "").otherwise(F.col("prediction")).alias("prediction"), "labels", F.col("question_pos").alias("pos"),
            F.when(bad, "").otherwise(F.col("context_text")).alias("context_text"), F.when(bad, no_ids).otherwise(plain).alias("item_ids"), F.when(bad, F.create_map().cast("map<string,double>")).otherwise(scored).alias("metrics"),
            F.when(bad, no_usage).otherwise(F.col("usage")).alias("usage"), F.when(bad, F.array(error.cast(ERROR))).otherwise(no_errors).alias("errors"),
        )
        none = lost.select(
            *ids, "status", "question", "reference", "prediction", "labels", F.col("question_pos").alias("pos"), F.lit("").alias("context_text"), no_ids.alias("item_ids"),
            F.create_map().cast("map<string,double>").alias("metrics"), no_usage.alias("usage"), F.col("errors").cast(f"array<{ERROR}>").alias("errors"),
        )
        trace = traces(plan)
        if keyed:
            runs = F.split("question_id", "/", 3)
            trace = trace.select(runs[0].cast("int").alias("construction_run"), runs[1].cast("int").alias("qa_run"), runs[2].alias("question_id"), "stage_index", "adapter", "query", "rank", F.substr("record_id", F.instr("record_id", "/") + 1).alias("record_id"), "score")
        rows = rows.unionByName(none)
        return (rows.withColumn("qa_run", F.explode("_runs")).drop("_runs"), trace.drop("qa_run")) if shared else (rows, trace)

    def _summary(self, build_run: int, run: int, seconds: dict[tuple, float]) -> bool:
        """Writes the run's usage, errors, status and figures; whether a question failed."""
        results = self.out.read(self.spark, "results", build_run, run)
        self.out.write("usage", results.select("question_id", F.explode("usage").alias("u")).select("question_id", "u.*"), build_run, run)
        self.out.write("errors", analytics.errors(results), build_run, run)
        timed = [(k, name, s) for (b, r, k, name), s in sorted(seconds.items()) if (b, r) == (build_run, run)]
        if timed:
            self.out.write("stage_timings", self.spark.createDataFrame(timed, "stage_index int, adapter string, seconds double"), build_run, run)  # one row for each stage
        counts = analytics.status_counts(results).first()
        means = {r["name"]: r["mean"] for r in analytics.metric_means(results).collect()}  # one row for each metric
        by_source = analytics.usage_by_source(analytics.usage_records(self.out.read(self.spark, "usage", build_run, run), results)).collect()
        place = self.out.root / "retrieve_qa" / f"construction_{build_run:03d}" / f"run_{run:03d}"
        prints = {"fingerprint": self.print, "execution_fingerprint": self.code}
        (place / "status.json").write_json({"status": "partial" if counts["failed"] else "completed", "questions": counts["questions"], "completed": counts["completed"], "failed": counts["failed"]} | prints)
        (place / "summary.json").write_json({"questions": counts["questions"], "completed": counts["completed"], "failed": counts["questions"] - counts["completed"], "metrics": means, "usage": {r["source"]: {"calls": r["calls"], "tokens": r["total_tokens"], "latency_ms": r["latency_ms"]} for r in by_source}})
        return counts["failed"] > 0
