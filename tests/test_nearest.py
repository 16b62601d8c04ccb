"""Vector search in blocks against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.functions.vectors import cosine
from strandmill.operators import nearest, ranking


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(3)
    vector = lambda: [rng.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(4)]  # many ties
    rows = [(k, vector()) for k in range(400)] + [(400, None), (401, [0.0] * 4), (402, [1.0]), (403, [1.0, None, 0.0, 0.0])]
    asked = [(f"q{k}", vector()) for k in range(30)] + [("zero", [0.0] * 4), ("none", None)]
    return spark.createDataFrame(asked, "question_id string, query_vector array<double>"), spark.createDataFrame(rows, "record_id long, vector array<double>").repartition(5)


def pairs(queries, records, k, *order):
    scored = queries.crossJoin(records).withColumn("score", ranking.score9(cosine(F.col("query_vector"), F.col("vector"))))
    return sorted(map(str, ranking.ranked(scored, k, F.desc("score"), *order).select("question_id", "record_id", "score", "rank").collect()))


def found(frame):
    return sorted(map(str, frame.select("question_id", "record_id", "score", "rank").collect()))


@pytest.mark.parametrize("block_bytes", [None, 500])
@pytest.mark.parametrize("k", [1, 7, 403, 500, None])
def test_same_as_all_pairs(both, monkeypatch, block_bytes, k):
    queries, records = both
    monkeypatch.setattr(nearest, "_ROWS", 64)
    monkeypatch.setattr(nearest, "_QUERIES", 8)
    if block_bytes:
        monkeypatch.setattr(nearest.nearest, "__kwdefaults__", nearest.nearest.__kwdefaults__ | {"block_bytes": block_bytes})
    assert found(ranking.cosine_topk(queries, records, k)) == pairs(queries, records, k, F.asc("record_id"))


def test_late_ties_and_other_orders(both):
    queries, records = both
    assert found(ranking.cosine_topk(queries, records, 9, descending_ties=True)) == pairs(queries, records, 9, F.desc("record_id"))
    named = records.withColumn("name", F.sha2(F.col("record_id").cast("string"), 256))
    assert found(ranking.cosine_topk(queries, named, 9, order="name")) == pairs(queries, named, 9, F.asc("name"))


def test_plan_has_no_pairs(both):
    queries, records = both
    plan = ranking.cosine_topk(queries, records, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Cross" not in plan


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
def test_hybrid_search(spark, alpha):
    rng = random.Random(6)
    texts = spark.createDataFrame([(k, " ".join(rng.choices("alpha beta gamma delta eps".split(), [5, 1, 1, 1, 1], k=rng.randint(0, 4)))) for k in range(120)], "record_id long, text string")
    vectors = spark.createDataFrame([(k, [rng.choice([-1.0, 1.0, 0.5]) for _ in range(3)]) for k in range(10, 130)], "record_id long, vector array<double>")
    asked = spark.createDataFrame([(0, "alpha"), (1, "beta gamma"), (2, "zzz"), (3, "alpha beta gamma delta eps")], "question_id long, query string")
    queries = spark.createDataFrame([(k, [1.0, -0.5, float(k)]) for k in range(5)], "question_id long, query_vector array<double>")
    held = texts.join(vectors.select("record_id"), "record_id", "left_semi")
    scored = ranking.bm25(asked, held, scope=[])
    cosines = queries.crossJoin(vectors).select("question_id", "record_id", ranking.score9(cosine(F.col("query_vector"), F.col("vector"))).alias("score"))
    want = ranking.hybrid_topk(scored, cosines, 6, alpha)
    assert found(ranking.hybrid_search(asked, ranking.corpus_of(held, []), queries, vectors, 6, alpha)) == found(want)


def test_only_survivors_are_encoded(spark):
    from strandmill.plans.stages import Stage, retrieve

    seen = spark.sparkContext.accumulator(0)

    def encode(column):
        @F.udf("array<double>")
        def one(text):
            seen.add(1)
            return [float(len(text)), 1.0]

        return one(column)

    records = spark.createDataFrame([("s", f"r{k}", k, f"word{k} museum" if k < 3 else f"word{k}") for k in range(50)], "sample_id string, record_id string, pos int, text string")
    asked = spark.createDataFrame([("s", f"q{k}", "museum") for k in range(4)], "sample_id string, question_id string, question string")
    plan = retrieve(asked, records, [Stage("bm25", 3), Stage("embedding_rerank", 2, params={"encode": encode})])
    assert plan.candidates.count() == 8 and seen.value <= 4 + 3
