"""Models behind column functions, and streams whose batches are written once."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import encoders
from strandmill.operators import ranking
from strandmill.plans.stages import Stage, build_reranker, default_stages, finished, retrieve
from strandmill.streaming import results


class Letters:
    """Counts of three letters; notes each load and the largest batch in files."""

    def __init__(self, place):
        self.place = place
        with open(os.path.join(place, f"load-{os.getpid()}"), "a") as f:
            f.write("x")

    def encode(self, texts):
        assert len(texts) <= 4
        return [[t.count("a") + 1, t.count("b"), t.count("c")] for t in texts]

    def predict(self, pairs):
        assert len(pairs) <= 4
        return [len(set(a) & set(b)) for a, b in pairs]


def test_encoder_and_scorer(spark, tmp_path):
    place = str(tmp_path)
    rows = spark.createDataFrame([(k, "a" * (k % 3) + "b" * (k % 5) if k else None) for k in range(200)], "id int, t string").repartition(3)
    encode = encoders.encoder("letters", lambda: Letters(place), batch=4)
    score = encoders.pair_scorer("letters", lambda: Letters(place), batch=4)
    found = rows.select("id", encode(F.col("t")).alias("v"), score(F.col("t"), F.lit("ab")).alias("s")).collect()
    for r in found:
        v = np.array([(r["id"] % 3 if r["id"] else 0) + 1, r["id"] % 5 if r["id"] else 0, 0], float)
        assert np.allclose(r["v"], v / np.linalg.norm(v)) and r["s"] == (r["id"] % 3 > 0) + (r["id"] % 5 > 0)
    assert all((tmp_path / f).read_text() == "x" for f in os.listdir(place))  # once for each process
    assert rows.limit(0).select(encode(F.col("t"))).count() == 0


def test_a_plan_with_models(spark, tmp_path):
    place = str(tmp_path)
    encode, score = encoders.encoder("plan", lambda: Letters(place), batch=4), encoders.pair_scorer("plan", lambda: Letters(place), batch=4)
    records = spark.createDataFrame([("s", f"r{k}", k, t) for k, t in enumerate(["aaa", "bbb", "ccc", "abc", "cab", ""])], "sample_id string, record_id string, pos int, text string")
    questions = spark.createDataFrame([("s", "q", "bb")], "sample_id string, question_id string, question string")
    stages = default_stages(2, reranker=build_reranker("cross_encoder", score), rerank_top_n=4, encode=encode)
    plan = retrieve(questions, records, stages)
    assert [s.top_k for s in stages] == [4, 2] and [r["record_id"] for r in finished(plan, 1).collect()] == ["r1"]
    assert [s.top_k for s in default_stages(3, "bm25")] == [3] and build_reranker("off") is None
    for wrong in (lambda: build_reranker("odd"), lambda: build_reranker("cross_encoder"), lambda: finished(plan, 0), lambda: Stage("embedding", 0)):
        with pytest.raises(ValueError):
            wrong()


def test_ties_keep_the_order_they_came_in(spark):
    candidates = spark.createDataFrame([("q", "z", 1, "x"), ("q", "a", 2, "y"), ("q", "m", 3, "z")], "question_id string, record_id string, rank int, extra string")
    queries, texts = spark.createDataFrame([("q", "ab")], "question_id string, query string"), spark.createDataFrame([("z", "1"), ("a", "2"), ("m", "3")], "record_id string, text string")
    same = lambda a, b: F.lit(1.0)
    assert [(r["record_id"], r["rank"], r["prior"], r["extra"]) for r in ranking.rerank_pairs(candidates, queries, texts, same, 2).orderBy("rank").collect()] == [("z", 1, 1, "x"), ("a", 2, 2, "y")]
    assert ranking.rerank_pairs(candidates, queries, texts, same, 0).count() == 0


def test_batches_are_written_once(spark, tmp_path):
    source, place, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    frame = lambda rows: spark.createDataFrame(rows, "unit string, n int").coalesce(1)
    run = lambda: results.write_batches(spark.readStream.schema("unit string, n int").option("maxFilesPerTrigger", 1).parquet(source), place, checkpoint)
    frame([("a", 1), ("b", 1)]).write.mode("append").parquet(source)
    query = run()
    query.processAllAvailable()
    query.stop()
    for name in ("0", ".0.crc"):
        if os.path.exists(os.path.join(checkpoint, "commits", name)):
            os.remove(os.path.join(checkpoint, "commits", name))  # as if the query had been lost before it noted the batch
    frame([("b", 2), ("c", 2)]).write.mode("append").parquet(source)
    query = run()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["unit"], r["n"], r["batch"]) for r in spark.read.parquet(place).collect()) == [("a", 1, 0), ("b", 1, 0), ("b", 2, 1), ("c", 2, 1)]
    assert sorted(map(tuple, results.latest(spark, place, ["unit"]).collect())) == [("a", 1), ("b", 2), ("c", 2)]
