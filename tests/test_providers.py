"""Providers against a server of our own, and failures of providers as rows."""

import json
import socket
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from strandmill import cli
from strandmill.functions import parsers, providers
from strandmill.operators import construct
from strandmill.plans import config, pages
from strandmill.plans.experiment import Runner
from strandmill.plans.index import Index
from strandmill.sources import artifacts
from tests.test_experiments import tree

SEEN = []


class Stub(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        SEEN.append((self.path, body, self.headers.get("Authorization")))
        replies = {
            "/api/chat": {"message": {"content": "from ollama"}, "prompt_eval_count": 3, "eval_count": 2},
            "/generate": {"text": "from sglang", "prompt_tokens": 4, "completion_tokens": 1},
            "/v1/chat/completions": {"choices": [{"message": {"content": '{"answer": "x"}' if "response_format" in body else "from chat"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 6}},
        }
        broken = "break" in json.dumps(body)
        raw = json.dumps(replies[self.path]).encode()
        self.send_response(500 if broken else 200)
        self.send_header("Content-Length", "0" if broken else str(len(raw)))
        self.end_headers()
        if not broken:
            self.wfile.write(raw)

    def log_message(self, *_):
        return


@pytest.fixture(scope="module")
def port():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_address[1]
    server.shutdown()


def closed_port() -> int:
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def model(provider, port, **params):
    place = {"host": "http://127.0.0.1", "port": port} if provider in ("sglang", "vllm") else {"base_url": f"http://127.0.0.1:{port}" + "/v1" * (provider in ("openai", "litellm"))}
    return {"provider": provider, "model": "m", "params": place | params}


@pytest.mark.parametrize(("provider", "path", "text", "tokens"), [("ollama", "/api/chat", "from ollama", (3, 2)), ("sglang", "/generate", "from sglang", (4, 1)), ("openai", "/v1/chat/completions", "from chat", (5, 6)), ("vllm", "/v1/chat/completions", "from chat", (5, 6)), ("litellm", "/v1/chat/completions", "from chat", (5, 6))])
def test_each_provider_is_asked_its_way(port, provider, path, text, tokens):
    llm = model(provider, port, max_tokens=9, api_key="k")
    found = providers.client(llm)("a prompt", 0.25)
    assert (found["text"], found["prompt_tokens"], found["completion_tokens"], found["source"]) == (text, *tokens, "reported")
    place, body, key = SEEN[-1]
    options = {"ollama": lambda b: b["options"], "sglang": lambda b: b["sampling_params"]}.get(provider, lambda b: b)(body)
    assert place == path and options["temperature"] == 0.25 and options["max_tokens"] == 9 and key == "Bearer k" and "a prompt" in json.dumps(body)
    assert llm["params"]["max_tokens"] == 9 and providers.reachable(llm) and not providers.reachable(model(provider, closed_port(), api_key="k"))


def test_objects_of_a_schema(port):
    schema = {"type": "object", "properties": {"answer": {"type": "string"}, "n": {"type": "integer"}, "tags": {"type": "array"}}}
    assert providers.structured(model("vllm", port), schema)("q") == {"answer": "x"}
    waits = []
    assert providers.structured(model("vllm", closed_port()), schema, sleep=waits.append)("q") == {"answer": "", "n": 0, "tags": []} and waits == [1.0, 2.0]
    assert providers.structured(model("sglang", port), schema)("q") == {"answer": "", "n": 0, "tags": []}  # no object


@pytest.mark.parametrize("llm", [{"provider": "sglang", "model": "m", "params": {"port": 1}}, {"provider": "openai", "model": "m", "params": {}}])
def test_a_batch_of_failures_is_a_batch_of_rows(spark, monkeypatch, llm):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    rows = spark.createDataFrame([(k, f"q{k}" if k else None) for k in range(5)], "id int, q string").repartition(2)
    found = rows.select("id", providers.completed(llm, F.col("q")).alias("r")).select("id", "r.*").collect()
    assert len(found) == 5 and all(r["text"] is None and r["total_tokens"] is None and r["latency_ms"] is None for r in found)
    assert all((r["error"] is None) == (r["id"] == 0) for r in found)


def test_some_calls_fail(spark, port):
    rows = spark.createDataFrame([(0, "fine"), (1, "break"), (2, "fine")], "id int, q string").coalesce(1)
    found = {r["id"]: r for r in rows.select("id", providers.completed(model("sglang", port), F.col("q")).alias("r")).select("id", "r.*").collect()}
    assert [found[k]["text"] for k in range(3)] == ["from sglang", None, "from sglang"] and "500" in found[1]["error"]


def test_a_failing_rewriter_fails_its_questions(spark, tmp_path):
    t = tree(tmp_path, "rewriter")
    down = {"provider": "sglang", "model": "m", "params": {"port": closed_port()}}
    t["pipeline"]["retrieve_qa"]["retrieval"]["stages"] = [{"adapter": "query_transform", "llm": down}, {"adapter": "query_transform"}, {"adapter": "bm25", "top_k": 1}]
    assert Runner(spark, config.validated(t)).run().exit_code == 2
    index = Index(spark, tmp_path / "out")
    rows = index.results("rewriter").collect()
    assert len(rows) == 4 and all(r["status"] == "failed" and r["errors"][0]["type"] == "URLError" and r["errors"][0]["retryable"] and r["prediction"] == "" and not r["usage"] and not r["metrics"] for r in rows)
    held = artifacts.Experiment(tmp_path / "out", "rewriter")
    assert held.read(spark, "traces", 0, 0).count() == 0 and held.read(spark, "usage", 0, 0).count() == 0 and held.read(spark, "errors", 0, 0).count() == 4
    assert index.usage("rewriter") == {} and index.errors("rewriter").count() == 4
    assert json.loads((held.root / "retrieve_qa" / "construction_000" / "run_000" / "status.json").read_text())["failed"] == 4


def test_a_rewriter_is_asked_once(spark, tmp_path, port):
    t = tree(tmp_path, "once")
    t["pipeline"]["retrieve_qa"]["retrieval"]["stages"] = [{"adapter": "query_transform", "llm": model("sglang", port), "params": {"prompt": "{question} or {question}"}}, {"adapter": "bm25", "top_k": 1}]
    SEEN.clear()
    assert Runner(spark, config.validated(t)).run().exit_code == 0
    assert sorted(b["text"] for _, b, _ in SEEN) == sorted(["What city? or What city?", "Who arrived? or Who arrived?"] * 2)
    assert Index(spark, tmp_path / "out").usage("once")["reported"]["calls"] == 4


def test_a_failing_answerer_and_a_failing_sample(spark, tmp_path, monkeypatch):
    t = tree(tmp_path, "sample")
    t["pipeline"]["construction"] = {"adapter": "amem", "llm": {"provider": "fake", "model": "m", "params": {"responses": []}}}
    t["pipeline"]["retrieve_qa"] |= {"context": {"adapter": "amem"}, "qa": {"adapter": "robust", "llm": {"provider": "openai", "model": "x", "params": {"base_url": f"http://127.0.0.1:{closed_port()}", "api_key": "k"}}}}

    def broken(responses):
        def complete(prompt, temperature=0.7):
            raise RuntimeError("no answer")

        return complete

    make = construct.build_notes
    first = lambda name: broken(()) if name.endswith(":0") else (_ for _ in ()).throw(ValueError(f"no model for {name}"))
    monkeypatch.setattr(construct, "build_notes", lambda turns, model, **options: make(turns, first, **options))
    assert Runner(spark, config.validated(t)).run().exit_code == 2
    index = Index(spark, tmp_path / "out")
    held = artifacts.Experiment(tmp_path / "out", "sample")
    status = json.loads((held.root / "construction" / "run_000" / "status.json").read_text())
    assert (status["status"], status["selected_samples"], status["completed_samples"], status["failed_samples"]) == ("partial", 2, 1, 1)
    found = {(r["sample_id"], r["question_id"] is None, r["type"], r["message"]) for r in index.errors("sample").collect()}
    assert ("locomo:1", True, "ValueError", "no model for locomo:1") in found
    assert ("locomo:1", False, "FileNotFoundError", "No construction store available for sample 'locomo:1'") in found
    assert any(s == "locomo:0" and kind == "URLError" for s, _, kind, _ in found) and index.results("sample").where("status = 'failed'").count() == 4
    assert [r["question_id"] for r in index.in_order("sample").collect()] == ["locomo:0:0", "locomo:0:1", "locomo:1:0", "locomo:1:1"]
    parts = index.graph("sample", 0, "locomo:0")
    assert parts["nodes"].count() == parts["records"].count() == 2 and parts["layers"].count() == 1 and parts["stores"].first()["metadata"] == {"method": "amem"}


def test_wrong_options_are_an_error_of_the_plan(spark):
    turns = spark.createDataFrame([], "sample_id string, turn_id string, turn_pos int, text string, timestamp string")
    with pytest.raises(ValueError, match="pruning"):
        construct.build_notes(turns, construct.rule_model, mode="odd")


def test_notes_without_a_turn_are_an_error(spark):
    turns = spark.createDataFrame([("s", "t0", 0, "word here", None, "D1:1", "ann", "1")], "sample_id string, turn_id string, turn_pos int, text string, timestamp string, evidence_id string, speaker string, session_id string")
    notes = construct.build_notes(turns, construct.rule_model)
    assert construct.enriched(notes, turns).first()["evidence_refs"] == ["D1:1"]
    with pytest.raises(Exception, match="no turn for note"):
        construct.enriched(notes.withColumn("record_id", F.lit("other")), turns).collect()


def test_stores_come_back_whole(spark, tmp_path):
    frames = {
        "records": spark.createDataFrame([("d:7", "r1", "hello")], "sample_id string, record_id string, text string"), "nodes": spark.createDataFrame([("d:7", "n1", "entity", "Alice")], "sample_id string, node_id string, type string, text string"),
        "edges": spark.createDataFrame([("d:7", "e1", "n1", "n2", "knows")], "sample_id string, edge_id string, source_id string, target_id string, type string"), "layers": spark.createDataFrame([], "sample_id string, name string, node_ids array<string>, edge_ids array<string>"),
        "stores": spark.createDataFrame([("d:7", "store/v1", {"index": "private/index.bin"}, {"method": "graph"})], "sample_id string, schema_version string, private_refs map<string,string>, metadata map<string,string>"),
    }
    place = str(tmp_path / "store")
    with pytest.raises(ValueError, match="layers"):
        artifacts.write_store(place, {k: v for k, v in frames.items() if k != "layers"})
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        artifacts.read_store(spark, place)
    artifacts.write_store(place, frames)
    back = artifacts.read_store(spark, place)
    assert {k: v.collect() for k, v in back.items()} == {k: v.collect() for k, v in frames.items()}


def test_pages(spark, tmp_path, monkeypatch):
    t = tree(tmp_path, "a")
    t["pipeline"]["retrieve_qa"]["qa"] = {"adapter": "failing", "params": {"question_ids": ["locomo:0:1"]}}
    assert Runner(spark, config.validated(t)).run().exit_code == 2
    index = Index(spark, tmp_path / "out")
    assert "/experiment?name=a" in pages.page(index, "/") and "intentional QA failure" in pages.page(index, "/experiment?name=a")
    assert "locomo:0:0" in pages.page(index, "/trace?name=a&question=locomo:0:0") and "Taipei" in pages.page(index, "/compare?a=a&b=a") and "records" in pages.page(index, "/graph?name=a&sample=locomo:0")
    served = []
    monkeypatch.setattr(pages.ThreadingHTTPServer, "serve_forever", lambda self: served.append(self.server_address))
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["dashboard", "--artifact-root", str(tmp_path / "out"), "--server-port", "0"]) == 0 and served[0][0] == "127.0.0.1"
    monkeypatch.undo()
    with pages.server(index, "127.0.0.1", 0) as held:
        threading.Thread(target=held.serve_forever, daemon=True).start()
        import urllib.error
        import urllib.request

        base = f"http://127.0.0.1:{held.server_address[1]}"
        assert b"name=a" in urllib.request.urlopen(base + "/").read()
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(base + "/nothing")
        held.shutdown()


def test_overview_command(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    path = tmp_path / "x.yaml"
    path.write_text(json.dumps(tree(tmp_path)))
    assert cli.main(["run", "--config", str(path)]) == 0 and capsys.readouterr().out == ""
    assert cli.main(["overview", "--artifact-root", str(tmp_path / "out")]) == 0 and json.loads(capsys.readouterr().out) == ["a"]
    assert cli.main(["overview", "--artifact-root", str(tmp_path / "out"), "--experiment", "a"]) == 0 and json.loads(capsys.readouterr().out)["questions"] == 4
    assert cli.main(["run", "--config", str(tmp_path / "none.yaml")]) == 1 and "none.yaml" in capsys.readouterr().err


@pytest.mark.parametrize(("reply", "expected"), [
    ("DECISION: strengthen and update\nREASON: both", ("STRENGTHEN_AND_UPDATE", "both")), ("DECISION: NO_EVOLUTION", ("NO_EVOLUTION", "")), ("I would update a neighbor", ("UPDATE_NEIGHBOR", "")), ("maybe strengthen, then update", ("STRENGTHEN_AND_UPDATE", "")), ("", ("NO_EVOLUTION", "")),
    ('{"should_evolve": true, "actions": ["strengthen"]}', ("STRENGTHEN", "")), ('{"should_evolve": false, "actions": ["strengthen"]}', ("NO_EVOLUTION", "")), ('{"decision": "X", "reason": "r"}', ("X", "r")), ('{"other": 1}', ("NO_EVOLUTION", "")),
])
def test_decisions(reply, expected):
    found = parsers.decision(reply)
    assert (found["decision"], found["reason"]) == expected


def test_links_and_updates():
    assert parsers.strengthening("CONNECTIONS: 0, 2, x, 3.5\nTAGS: a, b") == {"connections": [0, 2], "tags": ["a", "b"]}
    assert parsers.strengthening('{"suggested_connections": [1, 2.0, "3"], "tags_to_update": ["t"]}') | {"suggested_connections": 0, "tags_to_update": 0} == {"connections": [1, 2], "tags": ["t"], "suggested_connections": 0, "tags_to_update": 0}
    assert parsers.neighbour_updates("NEIGHBOR 1:\nCONTEXT: one\nTAGS: a, b\nNEIGHBOR 2:\nCONTEXT: two", 3) == [{"context": "", "tags": []}, {"context": "one", "tags": ["a", "b"]}, {"context": "two", "tags": []}]
    assert parsers.neighbour_updates('{"new_context_neighborhood": ["c"], "new_tags_neighborhood": [["t"], ["u"]]}', 3) == [{"context": "c", "tags": ["t"]}, {"context": "", "tags": ["u"]}, {"context": "", "tags": []}]
