"""What the runs and waves of an experiment share: the parsed dataset, answers without a model, and an index that is cut into terms once."""

from pyspark.sql import functions as F

from strandmill.plans import config, experiment
from strandmill.plans.experiment import Runner
from strandmill.plans.index import Index
from strandmill.sources.indexes import TextIndex
from strandmill.sources.json_array import Effect, read_both
from tests.test_experiments import tree


def test_runs_of_questions_over_a_store_are_answered_once(spark, tmp_path, monkeypatch):
    t = tree(tmp_path, "shared")
    t["pipeline"]["construction"]["runs"], t["pipeline"]["retrieve_qa"]["runs"] = 2, 3
    ranked, read, retrieve, parts = [], [], experiment.retrieve, Runner._parts
    monkeypatch.setattr(experiment, "retrieve", lambda questions, *rest: ranked.append(questions.count()) or retrieve(questions, *rest))
    monkeypatch.setattr(Runner, "_parts", lambda self: read.extend(self.data["questions"].inputFiles()) or parts(self))
    assert Runner(spark, config.validated(t)).run().exit_code == 0
    assert ranked == [8] and read and all("/shared/work/" in x for x in read)
    index = Index(spark, tmp_path / "out")
    rows = index.results("shared").collect()
    assert sorted((r["construction_run"], r["qa_run"], r["question_id"]) for r in rows) == [(b, q, f"locomo:{s}:{k}") for b in range(2) for q in range(3) for s in range(2) for k in range(2)]
    assert len({(r["question_id"], r["prediction"], tuple(r["item_ids"]), str(r["metrics"])) for r in rows}) == 4
    seen = experiment.Experiment(tmp_path / "out", "shared").read(spark, "traces").groupBy("construction_run", "qa_run", "question_id").count().collect()
    assert len(seen) == 24 and {r["count"] for r in seen} == {2}


def test_buckets_do_not_grow_with_the_questions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(experiment, "QUESTIONS_A_BUCKET", 1)
    monkeypatch.setattr(experiment, "BUCKETS", 1)
    run = Runner(spark, config.validated(tree(tmp_path, "few")))
    assert run.run().exit_code == 0
    assert (run.out.root / "retrieve_qa" / "layout.json").read_json()["buckets"] == 1 and Index(spark, tmp_path / "out").results("few").count() == 4


def test_postings_are_made_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        calls.add(1)
        return text.split()

    records = spark.createDataFrame([(f"s{k % 7}", f"r{k}", f"word{k % 3} shared") for k in range(40)], "sample_id string, record_id string, text string")
    index = TextIndex(str(tmp_path / "i"), tokenise=cut)
    index.append(records)
    assert calls.value == 2 * 40  # for postings and for sizes
    held = index.corpus(spark)
    assert held.postings.count() == 80 and {(r["sample_id"], r["term"], r["df"]) for r in held.terms.collect()} == {tuple(r) for r in held.postings.groupBy("sample_id", "term").count().collect()}


def test_marks_are_read_for_both_states_at_once():
    for text in (b'{"a": [1, {"b": "x}\\"{"}]}', b'tail" , "k": {"c": []}}, {"d', b'\\\\" ] }'):
        out, within = Effect(False), Effect(True)
        for k in range(0, len(text), 7 if b"\\" not in text else len(text)):
            read_both(out, within, text[k : k + (7 if b"\\" not in text else len(text))])
        quotes = text.replace(b"\\\\", b"").replace(b'\\"', b"").count(b'"')
        assert out.inside == bool(quotes % 2) and within.inside != out.inside
    out, within = Effect(False), Effect(True)
    read_both(out, within, b'{"a}": [{')
    assert (out.depth, dict(out.opened), out.first) == (3, {0: 1, 2: 1}, "{") and (within.depth, within.first) == (-1, "}")
