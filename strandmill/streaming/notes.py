"""The note fold on a stream, on keyed state: turns arrive in any micro-batch, and a batch reads and writes only the notes, terms and figures it touches.

State of a sample, each a map of its own: notes by place, places by record id, document frequencies by term, postings by term and block of
`BLOCK` records, and how many terms have each document frequency; and a few totals. Adding a note writes its own entry, one block for each of its terms, and the
neighbours that it changes. A search reads the blocks of its terms, as the ranking needs all of them, and the notes it finds. Only a consolidation
goes over all notes. The maps' entries lie in pages of about `PAGE` characters (`Pages`), as each call to the state costs many times what it brings: a short conversation is a page or two, and
a batch reads and writes it at once. The state lives in RocksDB.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandmill.operators.construct import NOTE_SCHEMA, Complete, Fold, Note

BLOCK = 64
PAGE = 1 << 14
MAPS = ("totals", "notes", "places", "frequencies", "postings", "spread", "waiting")
SMALL = ("totals", "spread")  # maps that are one entry
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = Row(*(c.split()[0] for c in NOTE_SCHEMA.split(", ")))


class Pages:
    """The maps of a sample in pages of one map of the state. A page is read when one of its entries is asked for, and written, if it was changed, by flush().

    An entry's page comes from the hash of its name. Pages grow in number with what they hold, one at a time: the next one takes its entries from one other (linear hashing), so
    they stay of one size and a sample's growth never moves all of it. The first page has the number of pages and what they hold in characters, under an empty name."""

    def __init__(self, state: Any, page: int = PAGE):
        self.state, self.page, self.held, self.changed = state, page, {}, set()
        first = self.state.getValue(("0",))
        self.held[0] = json.loads(first[0]) if first else {}
        self.fresh = first is None
        self.count, self.size = self.held[0].get("", (1, 0))

    def shelves(self) -> dict[str, Shelf]:
        return {name: Shelf(Paged(self, name, name in SMALL), self.fresh) for name in MAPS}

    def _place(self, name: str) -> int:
        low = 1 << (self.count.bit_length() - 1)
        at = zlib.crc32(name.encode("utf-8", "surrogatepass")) & (2 * low - 1)
        return at if at < self.count else at - low

    def _read(self, at: int) -> dict[str, Any]:
        if at not in self.held:
            found = self.state.getValue((str(at),))
            self.held[at] = json.loads(found[0]) if found else {}
        return self.held[at]

    def get(self, name: str) -> str | None:
        return self._read(self._place(name)).get(name)

    def put(self, name: str, value: str) -> None:
        at = self._place(name)
        before = self._read(at).get(name)
        self.size += len(value) - len(before) if before is not None else len(name) + len(value)
        self.held[at][name] = value
        self.changed.add(at)
        while self.size > self.page * self.count:
            self._split()

    def _split(self) -> None:
        new, old = self.count, self.count - (1 << (self.count.bit_length() - 1))
        self.count += 1
        held = self._read(old)
        self.held[new] = {name: held.pop(name) for name in [x for x in held if x and self._place(x) == new]}
        self.changed |= {old, new}

    def drop(self, start: str) -> None:
        """All entries whose name starts so: goes over all pages."""
        for at in range(self.count):
            held = self._read(at)
            for name in [x for x in held if x.startswith(start)]:
                self.size -= len(name) + len(held.pop(name))
                self.changed.add(at)

    def flush(self) -> None:
        if self.changed:
            self.held[0][""] = (self.count, self.size)
        for at in sorted(self.changed | {0} if self.changed else ()):
            self.state.updateValue((str(at),), (json.dumps(self.held[at]),))
        self.changed = set()


class Paged:
    """One map of those in pages, as a `Shelf` asks the state. A small map is one entry, so all of it is read without the others."""

    def __init__(self, pages: Pages, name: str, small: bool):
        self.pages, self.name, self.small = pages, name, small

    def _all(self) -> dict[str, str]:
        return json.loads(self.pages.get(f"{self.name}/") or "{}")

    def getValue(self, key: tuple) -> tuple | None:  # noqa: N802  Spark's names
        found = self._all().get(key[0]) if self.small else self.pages.get(f"{self.name}/{key[0]}")
        return None if found is None else (found,)

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        if self.small:
            self.pages.put(f"{self.name}/", json.dumps(self._all() | {key[0]: value[0]}))
        else:
            self.pages.put(f"{self.name}/{key[0]}", value[0])

    def iterator(self) -> Iterator[tuple]:
        if not self.small:
            raise ValueError(f"the map {self.name} is not read as a whole")
        return (((k,), (v,)) for k, v in self._all().items())

    def clear(self) -> None:
        self.pages.drop(f"{self.name}/")


class Shelf:
    """A map of the state, with what a batch has read of it and written to it: an entry is read and written once in a batch. An empty map is not asked for its entries."""

    def __init__(self, state: Any, empty: bool = False):
        self.state, self.held, self.changed, self.empty = state, {}, set(), empty

    def get(self, key: Any, default: Any = None) -> Any:
        if key not in self.held:
            found = None if self.empty else self.state.getValue((str(key),))
            self.held[key] = json.loads(found[0]) if found else default
        return self.held[key]

    def put(self, key: Any, value: Any) -> None:
        self.held[key] = value
        self.changed.add(key)

    def all(self) -> dict[str, Any]:
        """Every entry: only of maps that stay small."""
        out = {} if self.empty else {k[0]: json.loads(v[0]) for k, v in self.state.iterator()}
        return out | {str(k): v for k, v in self.held.items() if k in self.changed}

    def clear(self) -> None:
        self.state.clear()
        self.held, self.changed, self.empty = {}, set(), True

    def flush(self) -> None:
        for key in self.changed:
            self.state.updateValue((str(key),), (json.dumps(self.held[key]),))
            self.empty = False
        self.held, self.changed = {}, set()


class KeptIndex:
    """`construct.OkapiIndex` on state: the same places for the same query."""

    def __init__(self, totals: Shelf, frequencies: Shelf, postings: Shelf, spread: Shelf):
        self.totals, self.frequencies, self.postings, self.spread = totals, frequencies, postings, spread

    def add(self, document: str) -> None:
        terms = re.findall(r"\w+", document.lower())
        n = self.totals.get("documents", 0)
        self.totals.put("documents", n + 1)
        self.totals.put("tokens", self.totals.get("tokens", 0) + len(terms))
        for term, tf in Counter(terms).items():
            df = self.frequencies.get(term, 0)
            self.frequencies.put(term, df + 1)
            if df:
                self.spread.put(df, self.spread.get(df, 0) - 1)
            self.spread.put(df + 1, self.spread.get(df + 1, 0) + 1)
            block = f"{df // BLOCK} {term}"
            self.postings.put(block, [*self.postings.get(block, []), [n, tf, len(terms)]])

    def search(self, query: str, k: int) -> list[int]:
        n = self.totals.get("documents", 0)
        if k < 1 or not n:
            return []
        idf = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
        spread = sorted((int(df), c) for df, c in self.spread.all().items() if c)
        mean = sum(c * idf(df) for df, c in spread) / sum(c for _, c in spread) if spread else 0.0
        average = self.totals.get("tokens", 0) / n or 1.0
        scores: dict[int, float] = {}
        for term in re.findall(r"\w+", query.lower()):
            df = self.frequencies.get(term, 0)
            weight = idf(df) if df else 0.0
            weight = 0.25 * mean if weight < 0 else weight
            for block in range(-(-df // BLOCK)):
                for place, tf, length in self.postings.get(f"{block} {term}", []):
                    scores[place] = scores.get(place, 0.0) + weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))
        ranked = sorted((-s, p) for p, s in scores.items() if s)
        out = [p for s, p in ranked if s < 0][:k]
        # Whatever shares no term scores 0 and needs no look: the first places that are not ranked otherwise.
        scored = {p for _, p in ranked}
        at = 0
        while len(out) < k and at < n:
            out += [at] * (at not in scored)
            at += 1
        return out + [p for s, p in ranked if s > 0][: k - len(out)]

    def clear(self) -> None:
        for shelf in (self.frequencies, self.postings, self.spread):
            shelf.clear()
        self.totals.put("documents", 0)
        self.totals.put("tokens", 0)


class KeptFold(Fold):
    """A fold whose notes and index are on the state of one sample."""

    def __init__(self, complete: Complete, shelves: dict[str, Shelf], **options: Any):
        super().__init__(complete, **options)
        if self.search is not None:
            raise ValueError("a fold on a stream searches its own index")
        self.shelves, self.totals = shelves, shelves["totals"]
        self.index = KeptIndex(self.totals, shelves["frequencies"], shelves["postings"], shelves["spread"])
        self.evolved, self.failures, self.before = self.totals.get("evolved", 0), self.totals.get("failures", 0), self.totals.get("completions", 0)
        self.touched: set[int] = set()

    def count(self) -> int:
        return self.totals.get("notes", 0)

    def at(self, place: int) -> Note:
        return Note(**self.shelves["notes"].get(place))

    def save(self, place: int, note: Note) -> None:
        self.shelves["notes"].put(place, asdict(note))
        self.touched.add(place)

    def has(self, record_id: str) -> bool:
        return self.shelves["places"].get(record_id) is not None

    def append(self, note: Note) -> None:
        place = self.count()
        self.shelves["places"].put(note.record_id, place)
        self.totals.put("notes", place + 1)
        self.save(place, note)
        self.index.add(note.document())
        # A link to a place that was not there yet names its note from now on.
        self.touched.update(self.shelves["waiting"].get(place, []))
        for link in note.links:
            if isinstance(link, int) and link > place:
                self.shelves["waiting"].put(link, [*self.shelves["waiting"].get(link, []), place])

    def consolidate(self) -> None:
        self.index.clear()
        for place in range(self.count()):
            self.index.add(self.at(place).document())

    def changed_rows(self, sample_id: str) -> list[tuple]:
        """Rows of the notes that this batch has added or changed; the first has the batch's completions."""
        out, n = [], self.count()
        each = [[u[k] for u in self.usage] for k in ("prompt_tokens", "completion_tokens")]
        timed = [[t[k] for t in self.seconds] for k in (0, 1)]
        for place in sorted(self.touched):
            note = self.at(place)
            links = [self.at(t).record_id if isinstance(t, int) and 0 <= t < n else str(t) for t in note.links]
            first = not out
            out.append((sample_id, note.record_id, place, note.content, note.timestamp, note.context, list(map(str, note.keywords)), list(map(str, note.tags)), links, self.before + len(self.usage), *(each if first else ([], [])), self.failures, *(timed if first else ([], [])), None))
        return out

    def flush(self) -> None:
        for name, value in (("evolved", self.evolved), ("failures", self.failures), ("completions", self.before + len(self.usage))):
            self.totals.put(name, value)
        for shelf in self.shelves.values():
            shelf.flush()


class _Notes(StatefulProcessor):
    def __init__(self, model: Callable[[str], Complete], options: dict[str, Any]):
        self.model, self.options = model, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state, self.before = (handle.getMapState(name, "key string", "value string") for name in ("pages", "totals"))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        pages = Pages(self.state)
        if pages.fresh and self.before.exists():
            raise RuntimeError("the checkpoint has notes that are not in pages: start the stream anew")
        fold = KeptFold(self.model(key[0]), pages.shelves(), **self.options)
        for t in sorted(rows, key=lambda t: (t["turn_pos"] is None, t["turn_pos"])):
            if not fold.has(t["turn_id"]):  # a turn that comes again changes nothing
                fold.add(t["text"] or "", t["timestamp"], t["turn_id"])
        found = fold.changed_rows(key[0])
        fold.flush()
        pages.flush()
        return iter([_ROW(*x) for x in found])

    def close(self) -> None:
        """Nothing is open."""


def build_notes_stream(turns: DataFrame, model: Callable[[str], Complete], **options: Any) -> DataFrame:
    """The rows of a sample's notes that a batch adds or changes (update mode): the last row of each record_id is its note, and equals that of `build_notes`
    over the same turns in the same order. Within a batch turns go by turn_pos. Sets the session's state store to RocksDB, which this kind of state needs."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    grouped = turns.select("sample_id", "turn_id", "turn_pos", "text", "timestamp").groupBy("sample_id")
    return grouped.transformWithState(_Notes(model, options), NOTE_SCHEMA, "update", "None")
