"""The fold on keyed state against the fold over whole conversations."""

import random

import pytest

from strandmill.operators import construct
from strandmill.streaming import notes

SCHEMA = "sample_id string, turn_id string, turn_pos int, text string, timestamp string"


class Store:
    """A map of the state in memory, which counts what is read and written."""

    def __init__(self):
        self.rows, self.reads, self.writes = {}, 0, 0

    def containsKey(self, key):  # noqa: N802
        self.reads += 1
        return key in self.rows

    def getValue(self, key):  # noqa: N802
        return self.rows.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.writes += 1
        self.rows[key] = value

    def iterator(self):
        return iter(self.rows.items())

    def clear(self):
        self.rows.clear()


def shelves(stores):
    return {name: notes.Shelf(s) for name, s in stores.items()}


def stores():
    return {name: Store() for name in ("totals", "notes", "places", "frequencies", "postings", "spread", "waiting")}


def turns_of(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnop"]
    return [(f"t{k}", " ".join(rng.choices(words, k=6)) + " shared text") for k in range(n)]


@pytest.mark.parametrize("threshold", [3, 100])
def test_same_notes_whatever_the_batches(threshold):
    rng, held, last = random.Random(2), stores(), {}
    turns = turns_of(200)
    whole = construct.Fold(construct.rule_model("s"), evolution_threshold=threshold)
    for record, body in turns:
        whole.add(body, "now", record)
    at, tokens = 0, 0
    while at < len(turns):
        fold = notes.KeptFold(construct.rule_model("s"), shelves(held), evolution_threshold=threshold)
        for record, body in turns[at : (at := at + rng.randint(1, 9))]:
            fold.add(body, "now", record)
        for row in fold.changed_rows("s"):
            last[row[1]] = row
            tokens += len(row[10])
        fold.flush()
    want = {r[1]: r for r in whole.rows("s")}
    assert {k: r[:9] for k, r in last.items()} == {k: r[:9] for k, r in want.items()}
    assert tokens == len(whole.usage)


def test_a_batch_touches_what_it_needs():
    """One more turn writes as much after 400 notes as after 100."""
    held, writes = stores(), {}
    for k, (record, body) in enumerate(turns_of(401)):
        before = sum(s.writes for s in held.values())
        fold = notes.KeptFold(construct.rule_model("s"), shelves(held))
        fold.add(body, "now", record)
        fold.flush()
        writes[k] = sum(s.writes for s in held.values()) - before
    early, late = (sum(writes[k] for k in range(a, a + 50)) / 50 for a in (100, 350))
    assert late < 1.2 * early + 2


def test_kept_index_ranks_as_the_one_in_memory():
    rng, held = random.Random(5), stores()
    plain = construct.OkapiIndex()
    index = notes.KeptIndex(*(notes.Shelf(held[n]) for n in ("totals", "frequencies", "postings", "spread")))
    for _ in range(150):
        document = " ".join(rng.choices("a b c d e f g h".split(), [30, 9, 5, 3, 2, 1, 1, 1], k=rng.randint(0, 6)))
        plain.add(document)
        index.add(document)
        for query in ("a", "a b", "h zzz", "", "c c d"):
            assert index.search(query, 5) == plain.search(query, 5)


def test_links_that_wait_for_their_note():
    held = stores()
    fold = notes.KeptFold(construct.scripted(["KEYWORDS: one\nCONTEXT: c\nTAGS: t", "KEYWORDS: two\nCONTEXT: c\nTAGS: t", "DECISION: STRENGTHEN", "CONNECTIONS: 2\nTAGS: x"]), shelves(held))
    fold.add("first words", "now", "a")
    fold.add("second words", "now", "b")
    assert {r[1]: r[8] for r in fold.changed_rows("s")}["b"] == ["2"]
    fold.flush()
    fold = notes.KeptFold(construct.scripted([]), shelves(held))
    fold.add("third words", "now", "c")
    assert {r[1]: r[8] for r in fold.changed_rows("s")} == {"b": ["c"], "c": []}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, f"{s}{t}", k, body, None) for s in ("s", "u") for k, (t, body) in enumerate(turns_of(24, seed=ord(s)))]
    turns = spark.createDataFrame(rows, SCHEMA)
    for k in range(4):
        turns.where(f"turn_pos div 6 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
    turns.where("turn_pos < 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))  # come again
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "turns"))
    query = notes.build_notes_stream(stream, construct.rule_model).writeStream.foreachBatch(lambda frame, batch: frame.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    from strandmill.streaming.results import latest

    columns = ["sample_id", "record_id", "pos", "text", "context", "keywords", "tags", "links"]
    held = latest(spark, str(tmp_path / "out"), ["sample_id", "record_id"])
    want = construct.build_notes(turns, construct.rule_model)
    assert sorted(map(str, held.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    total = lambda frame: frame.selectExpr("sum(size(prompt_tokens))").first()[0]
    assert total(spark.read.parquet(str(tmp_path / "out"))) == total(want)


def test_an_empty_map_is_not_asked():
    """A new sample's entries are known to be missing; of others an entry takes one call to the state."""
    from strandmill.streaming.notes import Shelf

    class State:
        def __init__(self, held):
            self.held, self.calls = held, 0

        def getValue(self, key):  # noqa: N802
            self.calls += 1
            return self.held.get(key)

        def updateValue(self, key, value):  # noqa: N802
            self.held[key] = value

    state = State({})
    shelf = Shelf(state, True)
    assert [shelf.get("a"), shelf.get("b", 3), state.calls] == [None, 3, 0]
    shelf.put("a", 1)
    shelf.flush()
    assert [shelf.get("a"), shelf.get("b"), state.calls] == [1, None, 2]
