"""Note graphs built turn by turn: an ordered fold for each sample.

The fold is serial within a sample and independent between samples (`by_sample`). A sample's turns
are its state's size, so a task holds one conversation. The index of a sample's notes is kept incrementally
(term and document frequencies), where a rebuild for each note would be quadratic.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import parsers
from strandmill.functions import vocabulary as V

NEIGHBOURS = 5
NOTE_SCHEMA = "sample_id string, record_id string, pos int, text string, timestamp string, context string, keywords array<string>, tags array<string>, links array<string>, completions long, prompt_tokens array<long>, completion_tokens array<long>, failures long, stages array<string>, seconds array<double>, error string"

Complete = Callable[[str, float], str]


class OkapiIndex:
    """Okapi BM25 over growing documents; scores by the second formula of operators.ranking."""

    def __init__(self, documents: Iterable[str] = ()):
        self.lengths: list[int] = []
        self.held: dict[str, dict[int, int]] = {}
        self.spread: Counter[int] = Counter()  # how many terms have each document frequency
        for d in documents:
            self.add(d)

    def add(self, document: str) -> None:
        terms = re.findall(r"\w+", document.lower())
        place = len(self.lengths)
        self.lengths.append(len(terms))
        for term, n in Counter(terms).items():
            found = self.held.setdefault(term, {})
            if found:
                self.spread[len(found)] -= 1
            found[place] = n
            self.spread[len(found)] += 1

    def _idf(self, df: int) -> float:
        return math.log(len(self.lengths) - df + 0.5) - math.log(df + 0.5)

    def search(self, query: str, k: int) -> list[int]:
        """Places by score, then by place."""
        n = len(self.lengths)
        if k < 1 or not n:
            return []
        terms, mean = sum(self.spread.values()), 0.0
        if terms:
            mean = sum(c * self._idf(df) for df, c in sorted(self.spread.items()) if c) / terms
        average = sum(self.lengths) / n or 1.0
        scores = [0.0] * n
        for term in re.findall(r"\w+", query.lower()):
            found = self.held.get(term)
            if not found:
                continue
            idf = self._idf(len(found))
            idf = 0.25 * mean if idf < 0 else idf
            for place, tf in found.items():
                scores[place] += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * self.lengths[place] / average))
        return sorted(range(n), key=lambda p: (-scores[p], p))[:k]


@dataclass
class Note:
    record_id: str
    content: str
    timestamp: str
    keywords: list[str] = field(default_factory=list)
    context: str = "General"
    tags: list[str] = field(default_factory=list)
    links: list[Any] = field(default_factory=list)

    def document(self) -> str:
        return (self.context + " keywords: " + ", ".join(map(str, self.keywords))).strip()


class Fold:
    """One sample's notes. `complete` answers prompts; an exception in it is met as the ladder of failures says."""

    def __init__(self, complete: Complete, *, mode: str = "nltk", evolution_threshold: int = 100, now: str = "197001010000", search: Callable[[list[str], str, int], list[int]] | None = None):
        if mode not in parsers.MODES:
            raise ValueError(f"keyword pruning mode {mode!r}; use none, simple or nltk")
        self.complete, self.mode, self.threshold, self.now, self.search = complete, mode, evolution_threshold, now, search
        self.notes: dict[str, Note] = {}
        self.places: list[str] = []  # record ids in the order they came
        self.documents: list[str] = []
        self.index = OkapiIndex()
        self.evolved = 0
        self.usage: list[dict[str, int]] = []
        self.failures = 0
        self.seconds: list[tuple[str, float]] = []  # of each stage of each note; see operators.analytics.timing

    @contextmanager
    def _timed(self, stage: str) -> Iterator[None]:
        """Seconds of a stage that ends well."""
        began = time.perf_counter()
        yield
        self.seconds.append((stage, time.perf_counter() - began))

    def _ask(self, prompt: str, temperature: float = 0.7) -> str:
        reply = str(self.complete(prompt, temperature))
        self.usage.append({"prompt_tokens": len(prompt.split()), "completion_tokens": len(reply.split())})
        return reply

    def _make(self, content: str, timestamp: str | None, record_id: str | None) -> Note:
        try:
            found = parsers.analysis(self._ask(V.ANALYSE.format(content=content)), content, self.mode)
            if not found["keywords"]:
                found["keywords"] = parsers.items(self._ask(V.KEYWORDS_ONLY.format(content=content), 0.3))
            found = parsers.repaired(found, content, self.mode)
        except Exception:  # noqa: BLE001  a failing model leaves the guesses, unpruned
            self.failures += 1
            found = {"keywords": parsers.guessed_keywords(content), "context": parsers.guessed_context(content), "tags": parsers.guessed_keywords(content, 3)}
        return Note(record_id or str(uuid.uuid4()), content, timestamp or self.now, list(found["keywords"] or []), found["context"] or "General", list(found["tags"] or []))

    # What a fold asks of its notes; streaming.notes keeps them elsewhere.

    def count(self) -> int:
        return len(self.places)

    def at(self, place: int) -> Note:
        return self.notes[self.places[place]]

    def save(self, place: int, note: Note) -> None:
        """After a note has changed."""

    def append(self, note: Note) -> None:
        if note.record_id not in self.notes:
            self.places.append(note.record_id)
        self.notes[note.record_id] = note
        self.documents.append(note.document())
        self.index.add(self.documents[-1])

    def neighbours(self, query: str, k: int = NEIGHBOURS) -> tuple[str, list[int]]:
        """The lines shown of the nearest notes, and their places."""
        n = self.count()
        if not n:
            return "", []
        places = [p for p in (self.search(self.documents, query, k) if self.search else self.index.search(query, k)) if p < n]
        held = {p: self.at(p) for p in places}
        lines = [f"memory index:{p}\t talk start time:{held[p].timestamp}\t memory content: {held[p].content}\t memory context: {held[p].context}\t memory keywords: {held[p].keywords}\t memory tags: {held[p].tags}\n" for p in places]
        return "".join(lines), places

    def _connect(self, note: Note) -> tuple[str, list[int], str]:
        shown, places = self.neighbours(note.content)
        if not places:
            return shown, places, parsers.DECISIONS[0]
        kind = parsers.decision(self._ask(V.DECIDE.format(context=note.context, content=note.content, keywords=note.keywords, neighbours=shown)))["decision"]
        if kind in ("STRENGTHEN", "STRENGTHEN_AND_UPDATE"):
            found = parsers.strengthening(self._ask(V.STRENGTHEN.format(content=note.content, keywords=note.keywords, neighbours=shown)))
            note.links += found["connections"]
            note.tags = found["tags"] or note.tags
        return shown, places, kind

    def _evolve(self, note: Note, shown: str, places: list[int]) -> None:
        reply = self._ask(V.UPDATE.format(content=note.content, context=note.context, neighbours=shown, last=len(places) - 1, count=len(places)))
        for place, new in zip(places, parsers.neighbour_updates(reply, len(places)), strict=False):
            near = self.at(place)
            near.tags, near.context = new["tags"] or near.tags, new["context"] or near.context
            self.save(place, near)

    def add(self, content: str, timestamp: str | None = None, record_id: str | None = None) -> Note:
        """Construct, connect, evolve, store. A failure after construction keeps the note with what was changed so far."""
        with self._timed("construction"):
            note, kind = self._make(content, timestamp, record_id), parsers.DECISIONS[0]
        try:
            with self._timed("links"):
                shown, places, kind = self._connect(note)
            if kind in ("UPDATE_NEIGHBOR", "STRENGTHEN_AND_UPDATE"):
                with self._timed("evolution"):
                    self._evolve(note, shown, places)
        except Exception:  # noqa: BLE001
            self.failures += 1
            kind = parsers.DECISIONS[0]
        self.append(note)
        if kind != parsers.DECISIONS[0]:
            self.evolved += 1
            if self.evolved % self.threshold == 0:
                self.consolidate()
        return note

    def reprocess(self, record_id: str) -> bool:
        """Connects and evolves a note that is there already; whether it evolved. A failure leaves it as it is then."""
        note = self.notes[record_id]
        try:
            shown, places, kind = self._connect(note)
            if kind in ("UPDATE_NEIGHBOR", "STRENGTHEN_AND_UPDATE"):
                self._evolve(note, shown, places)
        except Exception:  # noqa: BLE001
            self.failures += 1
            return False
        return kind != parsers.DECISIONS[0]

    def related(self, query: str, k: int = NEIGHBOURS) -> str:
        """The nearest notes with up to k + 1 of each one's links after it, as text."""
        held = [self.at(p) for p in range(self.count())]
        show = lambda n: f"talk start time:{n.timestamp}memory content: {n.content}memory context: {n.context}memory keywords: {n.keywords}memory tags: {n.tags}\n"
        return "".join(show(held[q]) for p in self.neighbours(query, k)[1] for q in [p, *held[p].links[: k + 1]])

    def consolidate(self) -> None:
        """The index anew from the notes as they are."""
        self.documents = [n.document() for n in self.notes.values()]
        self.index = OkapiIndex(self.documents)

    def rows(self, sample_id: str) -> list[tuple]:
        ids = list(self.notes)
        each = [[u[k] for u in self.usage] for k in ("prompt_tokens", "completion_tokens")]
        timed = [[t[k] for t in self.seconds] for k in (0, 1)]
        out = []
        for pos, n in enumerate(self.notes.values()):
            links = [ids[t] if isinstance(t, int) and 0 <= t < len(ids) else str(t) for t in n.links]
            out.append((sample_id, n.record_id, pos, n.content, n.timestamp, n.context, list(map(str, n.keywords)), list(map(str, n.tags)), links, len(self.usage), *(each if pos == 0 else ([], [])), self.failures, *(timed if pos == 0 else ([], [])), None))
        return out

    def to_json(self) -> str:
        return json.dumps({"notes": [asdict(n) for n in self.notes.values()], "documents": self.documents, "evolved": self.evolved, "usage": self.usage, "failures": self.failures})

    def load(self, state: str) -> Fold:
        held = json.loads(state)
        self.notes = {n["record_id"]: Note(**n) for n in held["notes"]}
        self.places = list(self.notes)
        self.documents, self.evolved, self.usage, self.failures = held["documents"], held["evolved"], held["usage"], held["failures"]
        self.index = OkapiIndex(self.documents)
        return self


def scripted(responses: Iterable[str]) -> Complete:
    """Answers in the order given; running out is an error."""
    left = iter(list(responses))

    def complete(prompt: str, temperature: float = 0.7) -> str:
        try:
            return str(next(left))
        except StopIteration:
            raise RuntimeError("the script ran out of responses") from None

    return complete


def build_notes(turns: DataFrame, model: Callable[[str], Complete], **options: Any) -> DataFrame:
    """Notes of every sample. turns: sample_id, turn_id, turn_pos, text, timestamp, and construction_run where several runs are built at once; model: makes a sample's `complete`.

    A sample that fails as a whole is one row with an error and no record_id. Provider calls happen inside the tasks: write the result before it is read twice."""
    Fold(scripted(()), **options)  # wrong options are an error of the plan, not of each sample
    def fold(name: str, rows: list[dict[str, Any]]) -> list[tuple]:
        state = Fold(model(name), **options)
        for t in rows:
            state.add(t["text"] or "", t["timestamp"] if isinstance(t["timestamp"], str) else None, t["turn_id"])
        return state.rows(name)

    return by_sample(turns, fold)


def by_sample(turns: DataFrame, fold: Callable[[str, list[dict[str, Any]]], list[tuple]]) -> DataFrame:
    """The rows (`NOTE_SCHEMA`) that a fold makes of each sample's turns, in the order of turn_pos; of each run's, where there is a construction_run.

    Samples lie one after the other in a task, which holds one at a time and sends many samples' notes together: most samples have few turns, and a group of its own for each
    costs many times its fold. An error in a fold is one row of its sample."""
    by = [c for c in ("construction_run", "sample_id") if c in turns.columns]
    columns, names = [c.split()[0] for c in NOTE_SCHEMA.split(", ")], [*by[:-1], *(c.split()[0] for c in NOTE_SCHEMA.split(", "))]
    arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    kinds = [*([pa.int32()] if len(by) > 1 else []), *(arrow[c.split()[1]] for c in NOTE_SCHEMA.split(", "))]

    def notes(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = (row for batch in batches for at in range(0, batch.num_rows, 1024) for row in batch.slice(at, 1024).to_pylist())
        for key, own in groupby(rows, lambda row: tuple(row[c] for c in by)):
            try:
                found = fold(key[-1], list(own))
            except Exception as e:  # noqa: BLE001  an error is a value of its sample
                found = [(key[-1], *[None] * (len(columns) - 2), f"{type(e).__name__}: {e}")]
            held += [(*key[:-1], *x) for x in found]
            if len(held) >= 1024:
                yield notes(held)
                held = []
        if held:
            yield notes(held)

    dealt = turns.select(*by, "turn_id", "turn_pos", "text", "timestamp").repartition(*by).sortWithinPartitions(*by, F.asc_nulls_last("turn_pos"))
    return dealt.mapInArrow(run, ("construction_run int, " if len(by) > 1 else "") + NOTE_SCHEMA)


def enriched(notes: DataFrame, turns: DataFrame) -> DataFrame:
    """Notes with speaker, session and evidence of their turn; a note without a turn is an error."""
    of = turns.select(F.col("turn_id").alias("record_id"), "speaker", "session_id", F.array("evidence_id").alias("_refs"))
    lost = F.raise_error(F.concat(F.lit("no turn for note "), F.col("record_id")))
    return notes.join(of, "record_id", "left").withColumn("evidence_refs", F.when(F.col("_refs").isNull(), lost.cast("array<string>")).otherwise(F.col("_refs"))).drop("_refs")


def rule_model(sample_id: str) -> Complete:
    """A deterministic model for tests and benchmarks: it reads its answer off the prompt."""

    def complete(prompt: str, temperature: float = 0.7) -> str:
        if prompt.startswith("Analyze"):
            words = sorted({w for w in re.findall(r"[a-z]{4,}", prompt.rsplit("Content for analysis:", 1)[1].lower())})[:4]
            return f"KEYWORDS: {', '.join(words)}\nCONTEXT: about {' '.join(words[:2])}\nTAGS: {', '.join(words[:2])}"
        places = [int(p) for p in re.findall(r"memory index:(\d+)", prompt)]
        if prompt.startswith("You are"):
            return f"DECISION: {parsers.DECISIONS[len(places) % 4]}\nREASON: by rule"
        if prompt.startswith("Given the new memory and its neighbors"):
            return f"CONNECTIONS: {', '.join(map(str, places[:2]))}\nTAGS: linked, seen"
        return "\n".join(f"NEIGHBOR {k}:\nCONTEXT: updated {k}\nTAGS: updated" for k in range(0, len(places), 2))

    return complete
