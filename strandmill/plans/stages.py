"""Staged retrieval: a list of stages becomes one lazy plan over all questions.

Each stage ranks only what the stage before left, and computes its statistics over
these survivors. A stage's trace is kept as long rows (question, stage, rank, record, score).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import ranking
from strandmill.operators.context import joined  # noqa: F401  (part of the planner's surface)


@dataclass(frozen=True)
class Stage:
    adapter: str
    top_k: int = 10
    query: str = "current"
    params: dict[str, Any] = field(default_factory=dict)
    complete: Callable[[DataFrame, str], DataFrame] | None = None  # rewrites the column `query` by a model

    def __post_init__(self) -> None:
        if self.adapter not in STAGES:
            raise ValueError(f"unsupported retrieval stage {self.adapter!r}; available: {', '.join(sorted(STAGES))}")
        if self.top_k < 1 or self.query not in ("current", "original_question"):
            raise ValueError("top_k is at least 1; query is current or original_question")


@dataclass
class Plan:
    """candidates: sample_id, question_id, record_id, rank; asked: question_id, original, query."""

    candidates: DataFrame
    asked: DataFrame
    traces: list[DataFrame]
    records: DataFrame
    first: bool = True
    corpus: ranking.Corpus | None = None


def _asked(plan: Plan, stage: Stage) -> DataFrame:
    return plan.asked.select("sample_id", "question_id", F.col("original" if stage.query == "original_question" else "query").alias("query"))


def _bm25(plan: Plan, stage: Stage) -> DataFrame:
    asked = _asked(plan, stage)
    if plan.first:  # all records of the sample: statistics once for each sample
        if plan.corpus is None:
            plan.corpus = ranking.corpus_of(plan.records.drop("pos"), ["sample_id"])
        return ranking.bm25_topk(asked, plan.corpus, stage.top_k)
    left = plan.candidates.select("question_id", "record_id").join(plan.records.select("sample_id", "record_id", "text"), "record_id")
    return ranking.bm25_topk(asked, left, stage.top_k, scope=["question_id"])


def _limit(plan: Plan, stage: Stage) -> DataFrame:
    return plan.candidates.where(F.col("rank") <= stage.top_k).withColumn("score", F.lit(None).cast("double"))


def _transform(plan: Plan, stage: Stage) -> DataFrame:
    """Rewrites the query; the ranking stays, and top_k has no effect."""
    source = F.col("original" if stage.query == "original_question" else "query")
    if stage.complete is not None:
        plan.asked = stage.complete(plan.asked.withColumn("query", source), stage.params.get("prompt", "Generate concise retrieval keywords for this question:\n{question}"))
    elif stage.params.get("mode", "lowercase") == "lowercase":
        plan.asked = plan.asked.withColumn("query", F.lower(source))
    else:
        plan.asked = plan.asked.withColumn("query", F.concat(F.lit(stage.params.get("prefix", "")), source))
    return plan.candidates.withColumn("score", F.lit(None).cast("double"))


def _vectors(plan: Plan, stage: Stage) -> DataFrame:
    """Cosine of the encoder's vectors; params["encode"] maps a text column to an array column."""
    encode = stage.params.get("encode")
    if encode is None:
        raise ValueError("embedding stages need params['encode'], a function of a text column")
    queries = _asked(plan, stage).select("sample_id", "question_id", encode(F.col("query")).alias("query_vector"))
    if plan.first:  # all records of the sample: vectors meet by it, and no pair is sent before it is scored
        return ranking.cosine_topk(queries, plan.records.select("sample_id", "record_id", encode(F.col("text")).alias("vector")), stage.top_k, scope=["sample_id"])
    queries = queries.drop("sample_id")
    # Of several questions' candidates each record is encoded once, and no other.
    texts = plan.records.select("record_id", "text").join(plan.candidates.select("record_id").distinct(), "record_id", "left_semi")
    left = plan.candidates.select("question_id", "record_id").join(texts.select("record_id", encode(F.col("text")).alias("vector")), "record_id")
    return ranking.cosine_topk(queries, left, stage.top_k, scope=["question_id"])


def _pairs(plan: Plan, stage: Stage) -> DataFrame:
    """A pair score; params["score"] maps the query's and the record's text columns to a double column."""
    score = stage.params.get("score")
    if score is None:
        raise ValueError("cross_encoder needs params['score'], a function of two text columns")
    left = plan.candidates.select("question_id", "record_id").join(plan.records.select("record_id", "text"), "record_id").join(_asked(plan, stage), "question_id")
    return ranking.ranked(left.select("question_id", "record_id", ranking.score9(score(F.col("query"), F.col("text"))).alias("score")), stage.top_k, F.desc("score"), F.asc("record_id"))


def build_reranker(mode: str, score: Callable | None = None) -> Callable | None:
    """What scores a query and a text in the default plan: nothing for `off`, the given function of two text columns for `cross_encoder`."""
    if mode not in ("off", "cross_encoder"):
        raise ValueError(f"unsupported rerank mode: {mode}")
    if mode == "cross_encoder" and score is None:
        raise ValueError("cross_encoder needs a score, a function of two text columns")
    return score if mode == "cross_encoder" else None


def default_stages(k: int, mode: str = "embedding", *, reranker: Callable | None = None, rerank_top_n: int | None = None, encode: Callable | None = None) -> list[Stage]:
    """Candidates by text or by vector, then the re-ranker, if there is one; it gets at least k of them."""
    wide = max(k, rerank_top_n or k) if reranker is not None else k
    first = Stage("bm25", wide) if mode == "bm25" else Stage("embedding", wide, params={"encode": encode})
    return [first] + ([Stage("cross_encoder", k, query="original_question", params={"score": reranker})] if reranker is not None else [])


def finished(plan: Plan, final_k: int) -> DataFrame:
    """The candidates of the last stage, the first final_k of each question."""
    if final_k < 1:
        raise ValueError("final_k must be >= 1")
    return plan.candidates.where(F.col("rank") <= final_k)


def candidate_rows(plan: Plan) -> DataFrame:
    """Each candidate as a flat record: question_id, memory_id, memory_index, text, scores and ranks by stage, source_stage and its trace in order."""
    name = F.concat(F.col("adapter"), F.lit(":"), F.col("stage_index").cast("string"))
    steps = traces(plan).select("question_id", "record_id", F.struct("stage_index", name.alias("stage"), "rank", "score").alias("s"))
    by = steps.groupBy("question_id", "record_id").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    held = plan.candidates.join(by, ["question_id", "record_id"]).join(plan.records.select("record_id", F.col("pos").alias("memory_index"), "text"), "record_id")
    scored = F.filter("steps", lambda s: s["score"].isNotNull())
    return held.select(
        "question_id", F.col("record_id").alias("memory_id"), "memory_index", "text", F.map_from_entries(F.transform(scored, lambda s: F.struct(s["stage"], s["score"]))).alias("scores"),
        F.map_from_entries(F.transform("steps", lambda s: F.struct(s["stage"], s["rank"]))).alias("ranks"), F.element_at("steps", -1)["stage"].alias("source_stage"), F.transform("steps", lambda s: F.struct(s["stage"].alias("stage"), s["rank"].alias("rank"), s["score"].alias("score"))).alias("stage_trace"),
    )


STAGES: dict[str, Callable[[Plan, Stage], DataFrame]] = {"bm25": _bm25, "limit": _limit, "query_transform": _transform, "embedding": _vectors, "embedding_rerank": _vectors, "cross_encoder": _pairs}


def retrieve(questions: DataFrame, records: DataFrame, stages: list[Stage], keep: Callable[[DataFrame, int], DataFrame] | None = None, corpus: ranking.Corpus | None = None) -> Plan:
    """questions: sample_id, question_id, question; records: sample_id, record_id, pos, text. corpus: the records' postings, if they are written.

    keep(rows, stage index) may write a stage's result and read it again: then later stages, traces and answers share one computation of it."""
    if not stages:
        raise ValueError("at least one stage")
    asked = questions.select("sample_id", "question_id", F.col("question").alias("original"), F.col("question").alias("query"))
    start = asked.select("sample_id", "question_id").join(records.select("sample_id", "record_id", "pos"), "sample_id")
    start = start.withColumn("rank", F.row_number().over(ranking.Window.partitionBy("question_id").orderBy("pos"))).select("sample_id", "question_id", "record_id", "rank")
    plan = Plan(start, asked, [], records, corpus=corpus)
    for k, stage in enumerate(stages):
        out = STAGES[stage.adapter](plan, stage)
        out = keep(out, k) if keep is not None else out
        shown = plan.asked.select("question_id", "query") if stage.adapter == "query_transform" else _asked(plan, stage).select("question_id", "query")
        plan.traces.append(out.join(shown, "question_id").select("question_id", F.lit(k).alias("stage_index"), F.lit(stage.adapter).alias("adapter"), "query", "rank", "record_id", "score"))
        if "sample_id" not in out.columns:
            out = out.join(asked.select("question_id", "sample_id"), "question_id")
        plan.candidates = out.select("sample_id", "question_id", "record_id", "rank")
        plan.first = plan.first and stage.adapter == "query_transform"
    return plan


def traces(plan: Plan) -> DataFrame:
    """All stages' traces as rows."""
    out = plan.traces[0]
    for x in plan.traces[1:]:
        out = out.unionByName(x)
    return out


def stage_counts(plan: Plan, questions: DataFrame, records: DataFrame) -> DataFrame:
    """question_id, stage_index, input_count, output_count."""
    start = questions.select("sample_id", "question_id").join(records.groupBy("sample_id").agg(F.count("*").alias("n")), "sample_id").select("question_id", F.lit(-1).alias("stage_index"), "n")
    n = start.unionByName(traces(plan).groupBy("question_id", "stage_index").agg(F.count("*").alias("n")))
    window = ranking.Window.partitionBy("question_id").orderBy("stage_index")
    return n.withColumn("input_count", F.lag("n").over(window)).where("stage_index >= 0").select("question_id", "stage_index", "input_count", F.col("n").alias("output_count"))
