"""Waves of an experiment read what their samples need."""

from strandmill.operators import ranking
from strandmill.plans import config, experiment
from strandmill.plans.experiment import Runner
from strandmill.plans.index import Index
from strandmill.sources.indexes import SLOTS, TextIndex, slot
from tests.test_experiments import tree


def test_a_wave_reads_the_records_and_the_index_of_its_samples(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(experiment, "QUESTIONS_A_BUCKET", 1)
    monkeypatch.setattr(experiment, "BUCKETS_A_WAVE", 2)
    t = tree(tmp_path, "waves")
    t["pipeline"]["retrieve_qa"]["runs"] = 2
    answers, waves = Runner._answers, []

    def seen(self, part, questions, records, work, corpus=None, *rest, **named):
        waves.append(tuple(sorted({r["sample_id"] for r in x.select("sample_id").distinct().collect()}) for x in (questions, records, corpus.postings, corpus.terms, corpus.scopes, corpus.documents)))
        return answers(self, part, questions, records, work, corpus, *rest, **named)

    monkeypatch.setattr(Runner, "_answers", seen)
    assert Runner(spark, config.validated(t)).run().exit_code == 0
    # Both runs of questions over a store are of one wave.
    assert sorted(waves) == [(["0/locomo:0"],) * 6, (["0/locomo:1"],) * 6]
    rows = Index(spark, tmp_path / "out").results("waves").collect()
    assert sorted((r["qa_run"], r["question_id"]) for r in rows) == [(q, f"locomo:{s}:{k}") for q in range(2) for s in range(2) for k in range(2)]
    assert all(x.startswith(f"{r['sample_id']}:") for r in rows for x in r["item_ids"]) and {len(r["item_ids"]) for r in rows} == {2}


def test_ranges_of_slots_make_up_an_index(spark, tmp_path):
    records = spark.createDataFrame([(f"s{k % 5}", f"r{k}", f"word{k % 3} shared") for k in range(20)], "sample_id string, record_id string, text string")
    asked = spark.createDataFrame([(f"s{k}", f"q{k}", "shared word1") for k in range(5)], "sample_id string, question_id string, query string")
    index = TextIndex(str(tmp_path / "i"))
    for k in range(2):
        index.append(records.where(f"substring(record_id, 2) % 2 = {k}"), f"b{k}")
    found = lambda corpus: {tuple(r) for r in ranking.bm25_topk(asked, corpus, 3).select("question_id", "record_id", "rank", "score").collect()}
    whole, half = found(index.corpus(spark)), SLOTS // 2
    parts = [found(index.corpus(spark, x)) for x in ((0, half), (half, SLOTS))]
    low = {r["sample_id"] for r in records.where(slot("sample_id") < half).select("sample_id").distinct().collect()}
    assert parts[0] | parts[1] == whole and {f"s{q[1:]}" for q, *_ in parts[0]} == low and len(parts[0]) == 3 * len(low)
