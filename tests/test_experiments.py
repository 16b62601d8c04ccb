import json

import pytest

from strandmill import cli
from strandmill.operators import construct
from strandmill.plans import config, registry
from strandmill.plans.experiment import Runner
from strandmill.plans.index import Index
from strandmill.sources import dialogues

TALK = {"speaker_a": "Alice", "session_10": [{"speaker": "Bob", "text": "later", "blip_caption": "a cat"}], "session_2": [{"speaker": "Alice", "dia_id": "D2:1", "text": "early"}], "session_2_date_time": "1 Jan 2026"}
SIMPLE = {"session_1": [{"speaker": "Alice", "dia_id": "D1:1", "text": "Alice arrived."}, {"speaker": "Bob", "dia_id": "D1:2", "text": "We are in Taipei."}], "session_1_date_time": "1 Jan 2026"}
QA = [{"question": "What city?", "answer": "Taipei", "category": 1, "evidence": ["D1:2"]}, {"question": "Who arrived?", "answer": "Alice", "category": 1, "evidence": ["D1:1"]}]
SCRIPT = ["KEYWORDS: Alice, Taipei\nCONTEXT: Alice moved to Taipei\nTAGS: relocation", "KEYWORDS: Bob, Taipei\nCONTEXT: Bob visited Taipei\nTAGS: travel", "DECISION: STRENGTHEN\nREASON: same city", "CONNECTIONS: 0\nTAGS: travel, taipei"]


def tree(tmp_path, name="a", **runtime):
    path = tmp_path / "talks.json"
    path.write_text(json.dumps([{"conversation": SIMPLE, "qa": QA}] * 2))
    return {
        "experiment": {"id": name},
        "pipeline": {
            "stages": ["construction", "retrieve_qa"], "dataset": {"adapter": "locomo", "path": str(path)}, "construction": {"adapter": "turn_rag", "chunker": {"adapter": "turn"}},
            "retrieve_qa": {"retrieval": {"adapter": "staged", "stages": [{"adapter": "bm25", "top_k": 2}]}, "context": {"adapter": "records", "fields": ["timestamp", "speaker", "content"]}, "qa": {"adapter": "extractive"}, "metrics": [{"adapter": "exact_match"}, {"adapter": "f1"}]},
        },
        "runtime": {"artifact_root": str(tmp_path / "out"), "on_error": "continue"} | runtime,
    }


def test_dialogue_source(spark, tmp_path):
    path = tmp_path / "d.json"
    asked = [{"question": "When?", "answer": "Today", "category": 2}, {"question": "x", "category": 5}, {"question": "n", "answer": 7}]
    path.write_text(json.dumps([{"conversation": TALK, "qa": asked}]))
    found = dialogues.load(spark, str(path))
    assert [(r["turn_id"], r["text"], r["timestamp"]) for r in found["turns"].orderBy("turn_pos").collect()] == [("locomo:0:turn:D2:1", "early", "1 Jan 2026"), ("locomo:0:turn:D10:1", "[Image: a cat] later", None)]
    assert [(r["question_id"], r["reference"], r["labels"]) for r in found["questions"].orderBy("question_pos").collect()] == [("locomo:0:0", "Today", {"question_type": ["temporal"]}), ("locomo:0:1", "None", {"question_type": ["adversarial"]}), ("locomo:0:2", "7", {})]


def test_run_resume_and_views(spark, tmp_path):
    t = config.validated(tree(tmp_path, resume=True))
    assert Runner(spark, t).run().exit_code == 0
    timed = Runner(spark, t).out.read(spark, "stage_timings", 0, 0).collect()
    assert [(r["stage_index"], r["adapter"]) for r in timed] == [(0, "bm25")] and timed[0]["seconds"] > 0
    index = Index(spark, tmp_path / "out")
    seen = index.overview("a")
    assert seen["questions"] == 4 and seen["failed_questions"] == 0 and seen["metrics"]["exact_match"] == 0 and seen["taxonomy_breakdown"] == {"question_type": {"multi_hop": 4}}
    assert index.trace("a", "locomo:0:1")["stages"][0]["ranking"][0]["record_id"] == "locomo:0:turn:D1:1"
    with pytest.raises(KeyError):
        index.trace("a", "nothing")
    assert Runner(spark, t).run().exit_code == 0 and index.results("a").count() == 4 and index.experiments() == ["a"]
    other = tree(tmp_path, "b")
    other["pipeline"]["stages"] = ["retrieve_qa"]
    other["pipeline"]["retrieve_qa"] |= {"memory_source": {"experiment_id": "a"}, "qa": {"adapter": "failing", "params": {"question_ids": ["locomo:0:1"]}}}
    assert Runner(spark, config.validated(other)).run().exit_code == 2
    assert [r["message"] for r in index.errors("b").collect()] == ["intentional QA failure"]
    assert index.compare("a", "b").where("status_b = 'failed'").count() == 1
    other["runtime"]["on_error"], other["experiment"]["id"] = "stop", "c"
    assert Runner(spark, config.validated(other)).run().exit_code == 1
    (tmp_path / "talks.json").write_text(json.dumps([{"conversation": TALK, "qa": QA}]))
    with pytest.raises(ValueError, match="mismatch"):
        Runner(spark, config.validated(other)).run()


def test_note_experiment(spark, tmp_path):
    t = tree(tmp_path, "notes")
    t["pipeline"]["construction"] = {"adapter": "amem", "llm": {"provider": "fake", "model": "m", "params": {"responses": SCRIPT}}}
    t["pipeline"]["retrieve_qa"] |= {"context": {"adapter": "amem"}, "qa": {"adapter": "robust", "llm": {"provider": "fake", "model": "x", "params": {"response": "Taipei"}}}}
    t["pipeline"]["retrieve_qa"]["retrieval"]["stages"] = [{"adapter": "query_transform", "llm": {"provider": "fake", "model": "q", "params": {"response": "taipei"}}}, {"adapter": "bm25", "top_k": 1}]
    assert Runner(spark, config.validated(t)).run().exit_code == 0
    index = Index(spark, tmp_path / "out")
    assert index.usage("notes")["estimated"]["calls"] == 2 * 4 + 2 * 4
    assert [r["edge_id"] for r in index.graph("notes", 0, "locomo:0")["edges"].collect()] == ["locomo:0:turn:D1:2->locomo:0:turn:D1:1"]
    assert [len(r["item_ids"]) for r in index.results("notes").orderBy("question_id").collect()] == [2] * 4
    assert index.overview("notes")["metrics"]["exact_match"] == 0.5
    spent = {r["stage"]: r for r in index.timings("notes").collect()}
    assert spent["construction"]["count"] == 4 and spent["links"]["count"] == 4 and all(0 <= r["min"] <= r["avg"] <= r["max"] <= r["total"] for r in spent.values())
    assert index.timings("none").count() == 0


def test_missing_store_gives_failed_rows(spark, tmp_path):
    t = tree(tmp_path, "part")
    t["pipeline"]["construction"]["selection"] = {"sample_limit": 1}
    assert Runner(spark, config.validated(t)).run().exit_code == 2
    rows = Index(spark, tmp_path / "out").results("part").where("status = 'failed'").collect()
    assert len(rows) == 2 and all("No construction store" in r["errors"][0]["message"] for r in rows)


def test_fold_and_its_state():
    fold = construct.Fold(construct.scripted(SCRIPT))
    fold.add("Alice moved to Taipei", "t0", "m0")
    again = construct.Fold(construct.scripted(SCRIPT[1:])).load(fold.to_json())
    again.add("Bob visited Taipei", "t1", "m1")
    rows = again.rows("s")
    assert [r[1] for r in rows] == ["m0", "m1"] and rows[1][8] == ["m0"] and rows[1][7] == ["travel", "taipei"] and rows[0][9] == 4


def test_existing_notes_and_views_of_them():
    fold = construct.Fold(construct.rule_model("s"))
    for k in range(4):
        fold.add(f"word{k} shared text here", "t", f"n{k}")
    assert {s for s, _ in fold.seconds} <= {"construction", "links", "evolution"} and len([1 for s, _ in fold.seconds if s == "construction"]) == 4
    assert isinstance(fold.reprocess("n1"), bool) and fold.related("shared", 2).count("memory content") >= 2
    broken = construct.Fold(construct.scripted([])).load(fold.to_json())
    assert broken.reprocess("n1") is False and broken.failures == fold.failures + 1


def test_failures_leave_guesses():
    fold = construct.Fold(construct.scripted([]))
    note = fold.add("Paris trip. More.", "t", "n")
    assert note.keywords == ["paris", "trip", "more"][: len(note.keywords)] and note.context == "Paris trip." and fold.failures == 1


def test_incremental_index_equals_a_rebuild():
    docs = ["a b c", "b c d", "", "a a e", "f b"]
    grown = construct.OkapiIndex()
    for n, d in enumerate(docs):
        grown.add(d)
        for q in ("a", "b c", "zzz", ""):
            assert grown.search(q, 3) == construct.OkapiIndex(docs[: n + 1]).search(q, 3)
    assert grown.search("a", 0) == [] and construct.OkapiIndex().search("a", 3) == []


@pytest.mark.parametrize(("path", "value", "why"), [
    (("extra",), 1, "unknown key"), (("pipeline", "stages"), [], "needs a stage"), (("pipeline", "stages"), ["construction"] * 2, "duplicate"), (("pipeline", "construction", "chunker"), None, "chunker"),
    (("pipeline", "retrieve_qa", "qa"), {"adapter": "robust"}, "llm"), (("pipeline", "retrieve_qa", "retrieval", "stages"), [], "stage"), (("pipeline", "dataset", "adapter"), "nope", "available"), (("runtime", "max_workers"), 0, "at least 1"), (("experiment", "id"), "/x", "fit"),
])
def test_wrong_files(tmp_path, path, value, why):
    t = tree(tmp_path)
    at = t
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = value
    with pytest.raises(ValueError, match=why):
        config.validated(t)


def test_token_limits_and_fingerprints(tmp_path):
    t = tree(tmp_path)
    t["pipeline"]["construction"] = {"adapter": "amem", "llm": {"provider": "fake", "model": "m", "params": {"max_tokens": 0}}}
    with pytest.raises(ValueError, match="max_tokens"):
        config.validated(t)
    one = config.validated(tree(tmp_path))
    assert config.fingerprint(one) == config.fingerprint(config.validated(one)) != config.fingerprint(config.validated(tree(tmp_path, "z")))


def test_registry_and_command_line(tmp_path, capsys):
    held = registry.Registry("thing")
    held.register("b", 1)
    with pytest.raises(ValueError, match="already"):
        held.register("b", 2)
    with pytest.raises(ValueError, match="available: b"):
        held.get("c")
    assert cli.main(["list-components"]) == 0 and "failing" not in capsys.readouterr().out
    path = tmp_path / "x.yaml"
    path.write_text(json.dumps(tree(tmp_path)))
    assert cli.main(["validate", "--config", str(path)]) == 0 and json.loads(capsys.readouterr().out)["valid"]
    path.write_text("experiment: {}")
    assert cli.main(["validate", "--config", str(path)]) == 1


def test_provider_retries():
    from strandmill.functions.providers import client, with_retries

    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("no")
        return "yes"

    assert with_retries(flaky, sleep=waits.append)() == "yes" and waits == [1.0, 2.0]
    assert client({"provider": "fake", "model": "m", "params": {"response": "a b"}})("x y z")["total_tokens"] == 5


def test_streams(spark, tmp_path):
    from strandmill.operators.construct import NOTE_SCHEMA, build_notes, rule_model
    from strandmill.streaming import notes, usage

    rows = [("s", f"t{k}", k, f"word{k} shared text here", None) for k in range(4)]
    schema = "sample_id string, turn_id string, turn_pos int, text string, timestamp string"
    turns = spark.createDataFrame(rows, schema)
    for k in range(2):
        turns.where(f"turn_pos div 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "turns"))
    query = notes.build_notes_stream(stream, rule_model).writeStream.format("memory").queryName("noted").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    columns = [c.split()[0] for c in NOTE_SCHEMA.split(", ") if c.split()[0] in ("record_id", "context", "links")]
    batch = {tuple(map(str, r)) for r in build_notes(turns, rule_model).select(*columns).collect()}
    assert batch <= {tuple(map(str, r)) for r in spark.table("noted").select(*columns).collect()}
    one = spark.createDataFrame([("2026-01-01 00:10:00", 1, "a", 2.0), ("2026-01-01 01:50:00", 1, "a", 3.0)], "t string, user_id long, source string, value double").selectExpr("cast(t as timestamp) ts", "user_id", "source", "value")
    assert [(r["calls"], r["latency_ms"]) for r in usage.tumbling(one, "2 hours").collect()] == [(2, 5.0)]
    assert usage.sliding(one, "2 hours", "1 hour").count() == 3 and usage.sessions(one, "30 minutes").count() == 2
