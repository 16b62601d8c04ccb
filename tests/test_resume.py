"""Runs that are lost and go on, several runs at once, and the index that grows."""

import pytest
from pyspark.sql import functions as F

from strandmill.operators import ranking
from strandmill.plans import config, experiment
from strandmill.plans.experiment import Runner
from strandmill.plans.index import Index
from strandmill.sources.files import Place
from strandmill.sources.indexes import PARTS, TextIndex
from tests.test_experiments import tree


def files_of(place):
    return {str(p): (p.stat().st_mtime_ns, p.read_bytes()) for p in place.rglob("*.parquet")}


def test_a_lost_run_goes_on_with_the_buckets_that_are_missing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(experiment, "QUESTIONS_A_BUCKET", 1)
    monkeypatch.setattr(experiment, "BUCKETS_A_WAVE", 1)
    t = config.validated(tree(tmp_path, "lost", resume=True))
    answers, waves = Runner._answers, []

    def lost(self, part, questions, *rest, **named):
        waves.append(sorted(r["asked_id"] for r in questions.collect()))
        if len(waves) == 2:
            raise KeyboardInterrupt
        return answers(self, part, questions, *rest, **named)

    monkeypatch.setattr(Runner, "_answers", lost)
    with pytest.raises(KeyboardInterrupt):
        Runner(spark, t).run()
    results = tmp_path / "out" / "lost" / "tables" / "results"
    before = files_of(results)
    done = {r["question_id"] for r in Index(spark, tmp_path / "out").results("lost").collect()}
    assert before and done == set(waves[0]) and len(list((tmp_path / "out" / "lost" / "retrieve_qa" / "commits").rglob("bucket=*.json"))) == 1
    assert Runner(spark, t).run().exit_code == 0
    after = files_of(results)
    assert before.items() <= after.items() and len(after) > len(before)
    assert sorted(q for w in waves[1:] for q in w if w is not waves[1]) == sorted({"locomo:0:0", "locomo:0:1", "locomo:1:0", "locomo:1:1"} - done)
    index = Index(spark, tmp_path / "out")
    assert index.results("lost").count() == 4 and index.trace("lost", "locomo:1:1")["stages"][0]["latency_ms"] > 0
    assert not (tmp_path / "out" / "lost" / "work").exists() or not any((tmp_path / "out" / "lost" / "work").iterdir())


def test_failed_questions_are_answered_again_beside_the_others(spark, tmp_path):
    t = tree(tmp_path, "again", resume=True)
    t["pipeline"]["retrieve_qa"]["qa"] = {"adapter": "failing", "params": {"question_ids": ["locomo:0:1"]}}
    run = Runner(spark, config.validated(t))
    assert run.run().exit_code == 2
    first = {r["question_id"]: r for r in Index(spark, tmp_path / "out").results("again").collect()}
    run.tree["pipeline"]["retrieve_qa"]["qa"] = {"adapter": "extractive", "params": {}, "llm": None}  # the same prints: only what failed is left to do
    assert run.run().exit_code == 0
    second = {r["question_id"]: r for r in Index(spark, tmp_path / "out").results("again").collect()}
    assert second["locomo:0:1"]["status"] == "completed" and {k: v for k, v in first.items() if k != "locomo:0:1"} == {k: v for k, v in second.items() if k != "locomo:0:1"}
    assert Index(spark, tmp_path / "out").trace("again", "locomo:0:0")["stages"] and Index(spark, tmp_path / "out").trace("again", "locomo:0:1")["stages"]


def test_runs_are_answered_together(spark, tmp_path, monkeypatch):
    t = tree(tmp_path, "many")
    t["pipeline"]["construction"]["runs"] = t["pipeline"]["retrieve_qa"]["runs"] = 2
    t["pipeline"]["retrieve_qa"]["retrieval"]["stages"] = [{"adapter": "bm25", "top_k": 2}, {"adapter": "limit", "top_k": 1}]
    asked = []
    answers = Runner._answers
    monkeypatch.setattr(Runner, "_answers", lambda self, part, questions, *rest, **named: asked.append(questions.count()) or answers(self, part, questions, *rest, **named))
    assert Runner(spark, config.validated(t)).run().exit_code == 0
    index = Index(spark, tmp_path / "out")
    rows = index.results("many").collect()
    assert asked == [16] and len(rows) == 16
    assert len({(r["construction_run"], r["qa_run"]) for r in rows}) == 4 and len({(r["question_id"], r["prediction"], tuple(r["item_ids"])) for r in rows}) == 4
    trace = index.trace("many", "locomo:1:0", 1, 1)
    assert [s["adapter"] for s in trace["stages"]] == ["bm25", "limit"] and trace["stages"][1]["ranking"][0]["record_id"].startswith("locomo:1:turn:")


ROWS = [("s", f"r{k:02d}", f"word{k % 7} shared {'museum ' * (k % 3)}text{k}") for k in range(30)] + [("t", "r00", "museum alone"), ("t", "r01", ""), ("u", "r00", None)]
ASKED = [("s", "q0", "museum word3"), ("s", "q1", "zzz"), ("t", "q2", "museum museum"), ("u", "q3", "x"), ("v", "q4", "museum")]


@pytest.fixture(scope="module")
def both(spark):
    return spark.createDataFrame(ROWS, "sample_id string, record_id string, text string"), spark.createDataFrame(ASKED, "sample_id string, question_id string, query string")


def found(questions, corpus, k=4, **options):
    return sorted(tuple(r) for r in ranking.bm25_topk(questions, corpus, k, **options).select("question_id", "record_id", "rank", "score").collect())


def same_tables(a, b):
    for name in PARTS:
        columns = sorted(getattr(a, name).columns)
        assert sorted(getattr(b, name).columns) == columns
        assert sorted(map(str, getattr(a, name).select(*columns).collect())) == sorted(map(str, getattr(b, name).select(*columns).collect()))


def test_append_equals_rebuild(spark, both, tmp_path):
    records, questions = both
    grown, whole = TextIndex(str(tmp_path / "grown")), TextIndex(str(tmp_path / "whole"))
    whole.append(records)
    for k in range(3):
        grown.append(records.where(F.abs(F.hash("record_id")) % 3 == k), f"b{k}")
    same_tables(grown.corpus(spark), whole.corpus(spark))
    want = found(questions, records, scope=["sample_id"])
    assert found(questions, grown.corpus(spark)) == found(questions, whole.corpus(spark)) == want
    grown.append(records, "b1")  # a batch that is there counts once
    assert grown.batches() == ["b0", "b1", "b2"] and found(questions, grown.corpus(spark)) == want
    grown.compact()
    assert len(grown.batches()) == 1 and found(questions, grown.corpus(spark)) == want
    same_tables(grown.corpus(spark), whole.corpus(spark))


def test_a_lost_batch_or_compaction_changes_nothing(spark, both, tmp_path, monkeypatch):
    records, questions = both
    index = TextIndex(str(tmp_path / "i"))
    with pytest.raises(FileNotFoundError):
        index.corpus(spark)
    index.append(records.where("sample_id = 's'"), "a")
    index.append(records.where("sample_id <> 's'"), "b")
    want = found(questions, index.corpus(spark))
    (index.place / "commits" / "b").delete()  # lost before its commit
    assert {q for q, *_ in found(questions, index.corpus(spark))} == {"q0", "q1"}
    index.append(records.where("sample_id <> 's'"), "b")
    assert found(questions, index.corpus(spark)) == want
    monkeypatch.setattr(TextIndex, "drop", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        index.compact()
    monkeypatch.undo()
    assert found(questions, index.corpus(spark)) == want
    index.append(spark.createDataFrame([("v", "r9", "museum")], records.schema), "c")
    assert len(index.batches()) == 2 and [r[:3] for r in found(questions, index.corpus(spark)) if r[0] == "q4"] == [("q4", "r9", 1)]


@pytest.mark.parametrize(("name", "small", "large"), [("bm25_topk_conversations", 8, 14), ("neighbor_expansion", 12, 24)])
def test_plans_have_few_exchanges(spark, name, small, large):
    """Shuffles of the plan, with sides that may be broadcast and without; four of the latter join questions with their answers."""
    from strandmill.plans import catalogue
    from tests.conftest import TINY

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit, most in ((held, small), ("-1", large)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            plan = catalogue.QUERIES[name](spark, TINY)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        assert sum(plan.count(f"Exchange {kind}") for kind in ("hashpartitioning", "SinglePartition", "rangepartitioning")) <= most
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_corpus_without_a_scope(spark):
    records = spark.createDataFrame([(k, k, t) for k, t in enumerate(["a b", "b b", "c", "", "a c"])], "record_id long, pos long, text string")
    asked = spark.createDataFrame([(0, "b"), (1, "zzz"), (2, "a b c")], "question_id long, query string")
    first = {q: [r["record_id"] for r in ranking.bm25_topk(asked, records, 3, scope=[]).where(F.col("question_id") == q).orderBy("rank").collect()] for q in range(3)}
    assert first[0][0] == 1 and first[1] == [0, 1, 2] and len(first[2]) == 3
    every = {q: [r["record_id"] for r in ranking.ranked(ranking.bm25(asked, records, scope=[]), 3, F.desc("score"), F.asc("record_id")).where(F.col("question_id") == q).orderBy("rank").collect()] for q in range(3)}
    assert first == every
    okapi = {q: [r["record_id"] for r in ranking.okapi_topk(asked, records, 4, scope=[]).where(F.col("question_id") == q).orderBy("rank").collect()] for q in range(3)}
    from strandmill.functions.text import words

    plain = {q: [r["record_id"] for r in ranking.ranked(ranking.bm25(asked, records, scope=[], okapi=True, tokenise=words), 4, F.desc("score"), F.asc("pos")).where(F.col("question_id") == q).orderBy("rank").collect()] for q in range(3)}
    assert okapi == plain


def test_places(spark, tmp_path):
    place = Place(tmp_path / "x", spark)
    (place / "a.json").write_json({"é": 1})
    (place / "a.json").write_json({"é": 2})
    assert (place / "a.json").read_json() == {"é": 2} and place.children() == ["a.json"] and (place / "none").children() == []
    with pytest.raises(FileNotFoundError):
        (place / "none").read_text()
    (place / "d" / "f").write_text("new")
    (place / "e" / "f").write_text("old")
    (place / "d").move(place / "e")
    assert (place / "e" / "f").read_text() == "new" and not (place / "d").exists()
