"""The maps of the note stream's state in pages."""

import random

import pytest

from strandmill.operators import construct
from strandmill.streaming import notes
from tests.test_stream_state import Store, turns_of


class Counted(Store):
    def getValue(self, key):  # noqa: N802
        self.reads += 1
        return super().getValue(key)


def test_a_short_conversation_is_read_and_written_at_once():
    store = Counted()
    for k, (record, body) in enumerate(turns_of(6)):
        store.reads = store.writes = 0
        pages = notes.Pages(store)
        fold = notes.KeptFold(construct.rule_model("s"), pages.shelves())
        fold.add(body, "now", record)
        fold.flush()
        pages.flush()
        assert fold.count() == k + 1 and store.reads <= 2 and store.writes <= 2


@pytest.mark.parametrize("threshold", [3, 100])
@pytest.mark.parametrize("page", [200, 5000])
def test_same_notes_in_pages_of_any_size(threshold, page):
    rng, store, last = random.Random(2), Store(), {}
    turns = turns_of(120)
    whole = construct.Fold(construct.rule_model("s"), evolution_threshold=threshold)
    for record, body in turns:
        whole.add(body, "now", record)
    at = 0
    while at < len(turns):
        pages = notes.Pages(store, page)
        fold = notes.KeptFold(construct.rule_model("s"), pages.shelves(), evolution_threshold=threshold)
        for record, body in turns[at : (at := at + rng.randint(1, 9))]:
            fold.add(body, "now", record)
        last |= {row[1]: row for row in fold.changed_rows("s")}
        fold.flush()
        pages.flush()
    assert {k: r[:9] for k, r in last.items()} == {r[1]: r[:9] for r in whole.rows("s")}
    assert len(store.rows) == notes.Pages(store, page).count > 1


def test_pages_stay_of_a_size_and_a_batch_writes_some_of_them():
    store, writes = Store(), []
    for k in range(3000):
        pages, before = notes.Pages(store, 1000), store.writes
        pages.put(f"notes/{k}", "x" * 50)
        pages.flush()
        writes.append(store.writes - before)
    pages = notes.Pages(store, 1000)
    assert all(pages.get(f"notes/{k}") == "x" * 50 for k in range(3000)) and pages.get("notes/3000") is None
    assert pages.size == sum(len(f"notes/{k}") + 50 for k in range(3000)) and pages.count == -(-pages.size // 1000)
    assert max(len(v[0]) for v in store.rows.values()) < 6000 and max(writes) <= 4
    pages.drop("notes/1")
    pages.flush()
    again = notes.Pages(store, 1000)
    assert again.get("notes/1234") is None and again.get("notes/2") and again.size == sum(len(f"notes/{k}") + 50 for k in range(3000) if not str(k).startswith("1"))
