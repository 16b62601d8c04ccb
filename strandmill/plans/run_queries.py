"""Queries over whole experiment runs, the growing index, streams and completions; each with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import providers, text
from strandmill.functions import vocabulary as V
from strandmill.operators import construct, ranking
from strandmill.plans import sqltext as S
from strandmill.plans.catalogue import _ASKED, _asked, _turns, query, r6
from strandmill.plans.stages import Stage, retrieve, traces
from strandmill.sources import artifacts, indexes

# ---- runs: a dialogue file of all conversations, built and asked as an experiment file says


def _dialogues(spark, sf_dir) -> str:
    """The conversations as a dialogue file in the shared folder: one session each, questions and answers by turns."""
    turns, _, questions = _turns(spark, sf_dir)
    number = F.split("sample_id", ":")[1].cast("long")
    said = turns.groupBy(number.alias("n")).agg(F.array_sort(F.collect_list(F.struct("turn_pos", "speaker", "text"))).alias("t"))
    asked = questions.groupBy(number.alias("n")).agg(F.array_sort(F.collect_list(F.struct("question_pos", "question", F.col("reference").alias("answer"), (F.col("question_pos") % 4 + 1).alias("category")))).alias("q"))
    conversation = F.struct(F.transform("t", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))).alias("session_1"))
    qa = F.transform("q", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"), x["category"].alias("category")))
    place = artifacts.scratch(spark, "dialogues")
    # In the order of the conversations, which is that of the files' names.
    said.join(asked, "n", "left").orderBy("n").select(conversation.alias("conversation"), F.coalesce(qa, F.array().cast("array<struct<question:string,answer:string,category:bigint>>")).alias("qa")).write.json(place)
    return place


def _tree(root: str, path: str, name: str, **changes) -> dict:
    return {
        "experiment": {"id": name},
        "pipeline": {
            "stages": ["construction", "retrieve_qa"], "dataset": {"adapter": "locomo", "path": path}, "construction": {"adapter": "turn_rag", "chunker": {"adapter": "turn"}, "runs": 2},
            "retrieve_qa": {"runs": 2, "retrieval": {"adapter": "staged", "stages": [{"adapter": "bm25", "top_k": 2}]}, "context": {"adapter": "records", "fields": ["timestamp", "speaker", "content"]}, "qa": {"adapter": "extractive"}, "metrics": [{"adapter": "exact_match"}, {"adapter": "f1"}]},
        } | changes,
        "runtime": {"artifact_root": root, "on_error": "continue"},
    }


def _run(spark, sf_dir, name: str, **changes) -> tuple[str, str]:
    from strandmill.plans.config import validated
    from strandmill.plans.experiment import Runner

    root, path = artifacts.scratch(spark, "runs"), _dialogues(spark, sf_dir)
    Runner(spark, validated(_tree(root, path, name, **changes))).run()
    return root, path


_RUN = f"""conv AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
{S.TURNS.strip()}, u AS (SELECT r.*, row_number() OVER (PARTITION BY r.sample_id ORDER BY pos) AS k, c.n FROM records r JOIN conv c ON r.sample_id = 'conv:' || c.conv_id),
held AS (SELECT 'locomo:' || n AS sample_id, 'locomo:' || n || ':turn:D1:' || k AS record_id, {S.strip('text')} AS text, speaker FROM u),
asking AS (SELECT 'locomo:' || c.n AS sample_id, 'locomo:' || c.n || ':' || (row_number() OVER (PARTITION BY q.sample_id ORDER BY question_pos) - 1) AS question_id, question, reference FROM questions q JOIN conv c ON q.sample_id = 'conv:' || c.conv_id),
asked AS (SELECT sample_id, question_id, question AS query FROM asking), {S.bm25('b', 'asked', 'held', 'sample_id')}, t AS ({S.topk('b', 2)}),
ctx AS (SELECT question_id, string_agg(r.speaker || CASE WHEN r.text = '' THEN '' ELSE ' | ' || r.text END, chr(10) ORDER BY rank) AS c, string_agg(record_id, ',' ORDER BY rank) AS item_ids FROM t JOIN held r USING (record_id) GROUP BY question_id),
a AS (SELECT q.question_id, q.reference, item_ids, split_part(c, chr(10), 1) AS prediction FROM asking q JOIN ctx USING (question_id)),
answers AS (SELECT question_id, 'completed' AS status, prediction, item_ids, {S.exact('prediction', 'reference')} AS exact_match, round({S.f1('prediction', 'reference')}, 6) AS f1 FROM a)"""


def _shown(results: DataFrame) -> DataFrame:
    return results.select("construction_run", "qa_run", "question_id", "status", "prediction", F.array_join("item_ids", ",").alias("item_ids"), F.col("metrics")["exact_match"].alias("exact_match"), F.round(F.col("metrics")["f1"], 6).alias("f1"))


@query(f"WITH {_RUN} SELECT c.construction_run, q.qa_run, a.* FROM answers a, (VALUES (0::INT), (1)) c(construction_run), (VALUES (0::INT), (1)) q(qa_run)")
def experiment_runs(spark, sf_dir):
    """Two construction runs with two runs of questions each, from the dialogue file to the written results."""
    from strandmill.plans.index import Index

    root, _ = _run(spark, sf_dir, "runs")
    return _shown(Index(spark, root).results("runs"))


@query(f"WITH {_RUN} SELECT 1::INT AS construction_run, 0::INT AS qa_run, a.* FROM answers a")
def experiment_external_stores(spark, sf_dir):
    """Questions over one run of another experiment's stores."""
    from strandmill.plans.config import validated
    from strandmill.plans.experiment import Runner
    from strandmill.plans.index import Index

    root, path = _run(spark, sf_dir, "stores", stages=["construction"])
    tree = _tree(root, path, "asked", stages=["retrieve_qa"])
    tree["pipeline"]["retrieve_qa"] |= {"runs": 1, "memory_source": {"experiment_id": "stores", "construction_runs": [1]}}
    Runner(spark, validated(tree)).run()
    return _shown(Index(spark, root).results("asked"))


@query(f"""WITH {_RUN} SELECT 'seen' AS experiment, 'completed' AS status, 4 * count(*) AS questions, 0::BIGINT AS failed, round(avg(exact_match), 6) AS exact_match, round(avg(f1), 6) AS f1,
(SELECT count(*) FROM conv)::BIGINT * 2 AS stores, (SELECT count(*) FROM held)::BIGINT * 2 AS records FROM answers""")
def experiment_overview(spark, sf_dir):
    """Each written experiment with its manifest's status, its figures and the sizes of its stores."""
    from strandmill.plans.index import Index
    from strandmill.sources.artifacts import Experiment

    root, _ = _run(spark, sf_dir, "seen")
    index, rows = Index(spark, root), []
    for name in index.experiments():
        seen, held = index.overview(name), Experiment(root, name)
        rows.append((name, index.manifest(name)["status"], seen["questions"], seen["failed_questions"], round(seen["metrics"]["exact_match"], 6), round(seen["metrics"]["f1"], 6), held.read(spark, "stores").count(), held.read(spark, "records").count()))
    return spark.createDataFrame(rows, "experiment string, status string, questions long, failed long, exact_match double, f1 double, stores long, records long")


# ---- the index that grows


@query(f"WITH {S.TURNS}, {_ASKED}, {S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 3)}) SELECT question_id, record_id, rank, round(score, 6) AS score FROM t")
def text_index_appended(spark, sf_dir):
    """Records come in three batches, of which two are made one in between: the same ranks as over all records."""
    _, records, q = _turns(spark, sf_dir)
    index = indexes.TextIndex(artifacts.scratch(spark, "index"))
    part = F.pmod(F.xxhash64("record_id"), F.lit(3))
    rows = records.select("sample_id", "record_id", "text")
    for k in range(3):
        index.append(rows.where(part == k), f"batch{k}")
        if k == 1:
            index.compact()
    return ranking.bm25_topk(_asked(q), index.corpus(spark), 3).select("question_id", "record_id", "rank", r6("score"))


# ---- completions


_REWRITE = {"provider": "fake", "model": "m", "params": {"response": "  la the un  "}}
_TEMPLATE = "Keywords for: {question}"
_WORDS = "len(list_filter(regexp_split_to_array({0}, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+'), lambda x: x <> ''))::BIGINT"


@query(f"""WITH {S.TURNS}, asked AS (SELECT sample_id, question_id, 'la the un' AS query FROM questions), {S.bm25('b', 'asked', 'records', 'sample_id')}, t AS ({S.topk('b', 2)})
SELECT t.question_id, record_id, rank, round(score, 6) AS score, 'la the un' AS query, {_WORDS.format("'Keywords for: ' || question")} AS prompt_tokens FROM t JOIN questions USING (question_id)""")
def query_rewritten_by_completion(spark, sf_dir):
    """The completion, stripped, is the query from then on; the prompt is the template with the question."""
    _, records, q = _turns(spark, sf_dir)

    def rewrite(asked: DataFrame, template: str) -> DataFrame:
        reply = providers.completed(_REWRITE, F.replace(F.lit(template), F.lit("{question}"), F.col("query")))
        return asked.withColumn("_r", reply).withColumn("query", text.strip(F.col("_r.text"))).withColumn("prompt_tokens", F.col("_r.prompt_tokens")).drop("_r")

    plan = retrieve(q, records, [Stage("query_transform", params={"prompt": _TEMPLATE}, complete=rewrite), Stage("bm25", 2)])
    found = traces(plan).where("stage_index = 1").select("question_id", "record_id", "rank", r6("score"), "query")
    return found.join(plan.asked.select("question_id", "prompt_tokens"), "question_id")


@query(f"WITH {S.TURNS} SELECT turn_id, 'a fixed reply' AS reply, {_WORDS.format('text')} AS prompt_tokens, 3::BIGINT AS completion_tokens, {_WORDS.format('text')} + 3 AS total_tokens, 'estimated' AS source, NULL AS error FROM turns WHERE text IS NOT NULL")
def completion_usage(spark, sf_dir):
    """A provider that reports no tokens: words of prompt and reply are counted."""
    turns = _turns(spark, sf_dir)[0].where("text IS NOT NULL")
    found = turns.select("turn_id", providers.completed({"provider": "fake", "model": "m", "params": {"response": "a fixed reply"}}, F.col("text")).alias("r"))
    return found.select("turn_id", F.col("r.text").alias("reply"), "r.prompt_tokens", "r.completion_tokens", "r.total_tokens", "r.source", "r.error")


_IN = ", ".join(f"'{w}'" for w in sorted(V.FILTERED))


@query(f"""WITH {S.TURNS}, w AS (SELECT turn_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT turn_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM turns)),
f AS (SELECT turn_id, lower(w) AS low, min(i) AS i FROM w WHERE regexp_full_match(w, '[a-zA-Z]{{3,}}') AND lower(w) NOT IN ({_IN}) AND NOT ends_with(lower(w), 'says') GROUP BY 1, 2),
r AS (SELECT f.turn_id, low, row_number() OVER (PARTITION BY f.turn_id ORDER BY CASE WHEN regexp_matches(w.w, '^[A-Z]') THEN 0 ELSE 1 END, f.i) AS n FROM f JOIN w ON w.turn_id = f.turn_id AND w.i = f.i)
SELECT t.turn_id, coalesce(string_agg(low, '|' ORDER BY n) FILTER (WHERE n <= 5), '') AS keywords FROM turns t LEFT JOIN r USING (turn_id) GROUP BY t.turn_id""")
def guessed_keywords(spark, sf_dir):
    """Keywords without a completion: words of three ASCII letters and more, capitalised ones first."""
    return _turns(spark, sf_dir)[0].select("turn_id", F.array_join(text.capitalised_keywords(F.col("text"), sorted(V.FILTERED)), "|").alias("keywords"))


# ---- streams


def _streamed(spark, sf_dir, start) -> None:
    """The turns as a stream of files: each conversation in two batches, in order. start(stream) starts the query, which goes on from its checkpoint for the second half."""
    turns = _turns(spark, sf_dir)[0].select("sample_id", "turn_id", "turn_pos", "text", "timestamp")
    place = artifacts.scratch(spark, "turns")
    for half in (F.col("turn_pos") < 2, F.col("turn_pos") >= 2):
        turns.where(half).write.mode("append").parquet(place)
        running = start(spark.readStream.schema(turns.schema).parquet(place))
        running.processAllAvailable()
        running.stop()


@query(f"WITH {S.TURNS} SELECT sample_id, turn_id, turn_pos::BIGINT AS turn_pos, text FROM turns")
def stream_batches_once(spark, sf_dir):
    """A stream written batch by batch and read again: a batch that comes again replaces its own part."""
    from strandmill.streaming import results

    place = artifacts.scratch(spark, "batches")
    _streamed(spark, sf_dir, lambda stream: results.write_batches(stream, f"{place}/rows", f"{place}/checkpoint"))
    again = results.latest(spark, f"{place}/rows", ["turn_id"])
    return again.select("sample_id", "turn_id", F.col("turn_pos").cast("long").alias("turn_pos"), "text")


@query(f"WITH {S.TURNS} SELECT sample_id, count(*) AS notes, count(*) AS same FROM turns GROUP BY sample_id")
def note_stream_equals_batch(spark, sf_dir):
    """Notes built on a stream, with their state kept between batches, against notes built of whole conversations: how many there are, and how many are the same in all columns."""
    from strandmill.streaming import notes, results

    place = artifacts.scratch(spark, "notes")
    written = lambda frame, batch: results.write_batch(frame, f"{place}/rows", batch)
    noted = lambda stream: notes.build_notes_stream(stream, construct.rule_model).writeStream.foreachBatch(written)
    _streamed(spark, sf_dir, lambda stream: noted(stream).outputMode("update").option("checkpointLocation", f"{place}/checkpoint").start())
    columns = ["sample_id", "record_id", "pos", "text", "timestamp", "context", "keywords", "tags", "links"]
    streamed = results.latest(spark, f"{place}/rows", ["record_id"]).select(*columns)
    whole = construct.build_notes(_turns(spark, sf_dir)[0], construct.rule_model).select("record_id", F.struct(*columns).alias("w"))
    held = streamed.join(whole, "record_id", "left").select("sample_id", F.struct(*columns).eqNullSafe(F.col("w")).alias("same"))
    return held.groupBy("sample_id").agg(F.count("*").alias("notes"), F.count_if("same").alias("same"))
