import pytest

from strandmill.operators import graph, ranking
from strandmill.plans.stages import Stage, retrieve, stage_counts, traces


@pytest.fixture(scope="module")
def store(spark):
    rows = [("s", "long", 0, "museum " * 20 + "tickets"), ("s", "focused", 1, "museum tickets cafe"), ("s", "other", 2, "garden cooking")]
    return spark.createDataFrame(rows, "sample_id string, record_id string, pos int, text string"), spark.createDataFrame([("s", "q", "museum tickets")], "sample_id string, question_id string, question string")


def test_bm25_scores_of_the_known_store(store):
    records, questions = store
    found = {r["record_id"]: r["score"] for r in ranking.bm25(questions.withColumnRenamed("question", "query"), records, scope=["sample_id"]).collect()}
    assert abs(found["focused"] - 1.3318903935) < 1e-8 and abs(found["long"] - 1.3038019120) < 1e-8 and found["other"] == 0
    assert [r["record_id"] for r in retrieve(questions, records, [Stage("bm25", 2)]).candidates.orderBy("rank").collect()] == ["focused", "long"]


def test_transforms_and_selector(spark):
    records = spark.createDataFrame([("s", "original", 0, "Where Alice went"), ("s", "transformed", 1, "Taipei museum")], "sample_id string, record_id string, pos int, text string")
    asked = spark.createDataFrame([("s", "q", "Where did Alice go?")], "sample_id string, question_id string, question string")
    plan = retrieve(asked, records, [Stage("query_transform", params={"mode": "prefix", "prefix": "Taipei museum "}), Stage("bm25", 1, query="original_question")])
    assert [r["record_id"] for r in plan.candidates.collect()] == ["original"]
    rows = traces(plan).where("stage_index = 1").collect()
    assert rows[0]["query"] == "Where did Alice go?"
    counts = {r["stage_index"]: (r["input_count"], r["output_count"]) for r in stage_counts(plan, asked, records).collect()}
    assert counts == {0: (2, 2), 1: (2, 1)}
    with pytest.raises(ValueError, match="unsupported"):
        Stage("nothing")


def test_empty_texts_and_ties(spark):
    records = spark.createDataFrame([("s", "b", 0, ""), ("s", "a", 1, None), ("t", "c", 0, "x")], "sample_id string, record_id string, pos int, text string")
    asked = spark.createDataFrame([("s", "q", "x y"), ("u", "r", "x")], "sample_id string, question_id string, question string")
    found = retrieve(asked, records, [Stage("bm25", 5)]).candidates.orderBy("rank").collect()
    assert [(r["question_id"], r["record_id"]) for r in found] == [("q", "a"), ("q", "b")]


def test_encoder_and_pair_stages(spark, store):
    from pyspark.sql import functions as F

    records, questions = store
    encode = lambda t: F.array(F.length(t).cast("double"), F.lit(1.0))
    plan = retrieve(questions, records, [Stage("embedding", 2, params={"encode": encode}), Stage("cross_encoder", 1, params={"score": lambda q, t: F.length(t).cast("double")})])
    assert [r["record_id"] for r in plan.candidates.collect()] == ["focused"]


def test_expansion(spark):
    records = spark.createDataFrame([("s", "m0"), ("s", "m1"), ("s", "m2")], "sample_id string, record_id string")
    items = spark.createDataFrame([("s", "q", "m1", 1)], "sample_id string, question_id string, record_id string, rank int")
    links = spark.createDataFrame([("s", "m1", 0, "m0"), ("s", "m1", 1, "m0"), ("s", "m1", 2, "gone"), ("s", "m1", 3, "m1")], "sample_id string, record_id string, link_pos int, target_id string")
    assert [(r["record_id"], r["rank"], r["source_id"]) for r in graph.expand(items, links, records).orderBy("rank").collect()] == [("m1", 1, None), ("m0", 2, "m1")]
    assert [r["record_id"] for r in graph.expand_capped(items, links, records, 1).orderBy("place").collect()] == ["m1", "m0", "m0"]


def test_bm25_plan_joins_by_key_and_limits_by_group(spark, store):
    records, questions = store
    plan = retrieve(questions, records, [Stage("bm25", 2)]).candidates._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "ArrowEvalPython" not in plan


def test_indexes_as_tables(spark, store, tmp_path):
    from strandmill.sources import indexes

    records, _ = store
    indexes.save_text_index(records, str(tmp_path))
    indexes.save_vector_index(records.selectExpr("sample_id", "record_id", "array(1d) as vector"), str(tmp_path))
    assert {(r["record_id"], r["tf"]) for r in indexes.load_index(spark, str(tmp_path), "postings").where("term = 'museum'").collect()} == {("long", 20), ("focused", 1)}
    assert indexes.load_index(spark, str(tmp_path), "vectors").count() == 3
    with pytest.raises(ValueError, match="pickle"):
        indexes.load_index(spark, str(tmp_path), "pickle")
