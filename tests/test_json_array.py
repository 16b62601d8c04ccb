"""Large JSON arrays in blocks against json.loads."""

import json
import random

import pytest

from strandmill.sources import dialogues, json_array


def odd_value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 4)
    if kind < 3:
        return "".join(rng.choices(['"', "\\", "}", "{", "[", "]", "é", "🙂", "a", " ", "\n", "\\\"}", ","], k=rng.randint(0, 30)))
    if kind == 3:
        return rng.choice([None, True, 1.5, -3])
    if kind == 4:
        return rng.randint(0, 10**9)
    if kind == 5:
        return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}" + rng.choice(["", '"', "}"]): odd_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.mark.parametrize(("indent", "size", "ascii_only"), [(None, "200", True), (2, "333", False), (None, "1m", False)])
def test_elements(spark, tmp_path, indent, size, ascii_only):
    rng = random.Random(str((indent, size)))
    whole = [{"n": k, "v": odd_value(rng), "w": odd_value(rng)} for k in range(60)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(whole, indent=indent, ensure_ascii=ascii_only) + rng.choice(["", "\n"]), encoding="utf-8")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, size)
    try:
        found = json_array.elements(spark, str(path))
        rows = {r["pos"]: json.loads(r["text"]) for r in found.collect()}
        blocks = found.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [rows[k] for k in sorted(rows)] == whole and sorted(rows) == list(range(60))
    assert size == "1m" or blocks > 8


def test_small_and_broken_files(spark, tmp_path):
    for text, want in (("[]", []), ("", []), ('{"a": 1}', [{"a": 1}]), ('  [ {"a": "}"} , {"b": []} ]\n', [{"a": "}"}, {"b": []}])):
        (tmp_path / "x.json").write_text(text)
        assert [json.loads(r["text"]) for r in json_array.elements(spark, str(tmp_path / "x.json")).orderBy("pos").collect()] == want
    for text in ('[{"a": 1}, {"a": "', '[{"a": [1, 2}', '[{"a": 1}'):
        (tmp_path / "x.json").write_text(text)
        if text.endswith('"a": 1}'):  # only the bracket of the array is missing
            continue
        with pytest.raises(ValueError, match="ends inside"):
            json_array.elements(spark, str(tmp_path / "x.json"))


def test_dialogues_of_many_blocks(spark, tmp_path):
    samples = [{"conversation": {"session_1": [{"speaker": "A", "dia_id": "D1:1", "text": f"text {k} }}] \""}], "session_1_date_time": "now"}, "qa": [{"question": f"q{k}", "answer": k, "category": 1}]} for k in range(40)]
    (tmp_path / "d.json").write_text(json.dumps(samples, indent=1))
    one = {n: sorted(map(str, f.collect())) for n, f in dialogues.load(spark, str(tmp_path / "d.json")).items()}
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    try:
        many = {n: sorted(map(str, f.collect())) for n, f in dialogues.load(spark, str(tmp_path / "d.json")).items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert one == many and len(one["turns"]) == 40 and "locomo:39:turn:D1:1" in str(one["turns"])
