"""A first stage by vectors."""

from pyspark.sql import functions as F

from strandmill.plans.stages import Stage, retrieve, traces


def test_first_embedding_stage_meets_by_sample(spark):
    # Both samples have a record r0: it is another one in each.
    records = spark.createDataFrame([("s", "r0", 0, "aaaa"), ("s", "r1", 1, "a"), ("t", "r0", 0, "bb")], "sample_id string, record_id string, pos int, text string")
    asked = spark.createDataFrame([("s", "q", "aaaa"), ("t", "p", "bb")], "sample_id string, question_id string, question string")
    encode = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    found = traces(retrieve(asked, records, [Stage("embedding", 3, params={"encode": encode})]))
    assert sorted(tuple(r) for r in found.select("question_id", "rank", "record_id").collect()) == [("p", 1, "r0"), ("q", 1, "r0"), ("q", 2, "r1")]
    again = retrieve(asked, records, [Stage("embedding", 3, params={"encode": encode}), Stage("limit", 1)])
    assert sorted(tuple(r) for r in again.candidates.select("sample_id", "question_id", "record_id").collect()) == [("s", "q", "r0"), ("t", "p", "r0")]
