"""Note graphs by one structured completion for each note: links, tags and the neighbours' changes come in one object.

Beside `operators.construct`, which asks step by step. Neighbours are the nearest by vectors of an encoder; of equal ones the later note comes first.
The fold is serial within a sample, and independent between samples.

What a reply does: `strengthen` adds the connections and sets the tags, `update_neighbor` sets tags and context of the neighbours in their order, as far as there are
tags for them; a neighbour without a context of its own keeps what it has. A reply that is no object, or does not say whether to evolve, changes nothing. An analysis that
is no object leaves a note without keywords and tags, in the context General. An error of the provider is the sample's.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from strandmill.functions import parsers
from strandmill.operators.construct import NEIGHBOURS, Note, by_sample

_TEXT, _TEXTS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}


def _schema(**properties: dict[str, Any]) -> dict[str, Any]:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


#: Names and types of the fields of both replies.
ANALYSIS = _schema(keywords=_TEXTS, context=_TEXT, tags=_TEXTS)
EVOLUTION = _schema(
    should_evolve={"type": "boolean"}, actions=_TEXTS, suggested_connections={"type": "array", "items": {"type": "integer"}}, tags_to_update=_TEXTS,
    new_context_neighborhood=_TEXTS, new_tags_neighborhood={"type": "array", "items": _TEXTS},
)

ASK_ANALYSIS = """Analyse the text below. Reply with one JSON object: "keywords" (at least three, the most important first, no speakers and no times),
"context" (one sentence: subject, main points, purpose) and "tags" (at least three broad categories).

Text:
{content}"""
ASK_EVOLUTION = """A new note joins a memory. Decide from it and its nearest notes whether links and notes change.

New note
context: {context}
content: {content}
keywords: {keywords}

Its {count} nearest notes
{neighbours}
Reply with one JSON object: "should_evolve"; "actions", of "strengthen" and "update_neighbor"; for the first "suggested_connections" (indices of notes) and
"tags_to_update" (tags of the new note); for the second "new_context_neighborhood" and "new_tags_neighborhood", one entry for each of the {count} notes in the order above."""

#: prompt and schema to the reply's text.
Complete = Callable[[str, dict[str, Any]], str]
Encode = Callable[[list[str]], Any]


def object_in(reply: str) -> dict[str, Any] | None:
    """The object from the first to the last brace of a reply, with what stands around it left out."""
    low, high = reply.find("{"), reply.rfind("}")
    try:
        found = json.loads(reply[low : high + 1]) if 0 <= low < high else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


class Vectors:
    """The nearest of growing documents by cosine, all held against the query; ties go to the later one."""

    def __init__(self, encode: Encode):
        self.encode, self.texts, self.units = encode, [], np.empty((0, 0))

    def _unit(self, text: str) -> np.ndarray:
        v = np.asarray(self.encode([text])[0], np.float64)
        return v / (np.linalg.norm(v) or 1.0)

    def add(self, text: str) -> None:
        self._put(len(self.texts), text)

    def _put(self, place: int, text: str) -> None:
        unit = self._unit(text)
        if place >= len(self.units):  # room for twice as many
            grown = np.zeros((2 * place + 8, len(unit)))
            if place:
                grown[:place] = self.units[:place]
            self.units = grown
        self.units[place] = unit
        self.texts[place : place + 1] = [text]

    def again(self, texts: list[str]) -> None:
        """All documents anew: those whose text has changed are encoded again."""
        for place, text in enumerate(texts):
            if place >= len(self.texts) or self.texts[place] != text:
                self._put(place, text)

    def search(self, text: str, k: int) -> list[int]:
        if k < 1 or not self.texts:
            return []
        near = np.round(self.units[: len(self.texts)] @ self._unit(text), 9)
        return np.argsort(near, kind="stable")[::-1][:k].tolist()


class SchemaFold:
    """One sample's notes."""

    def __init__(self, complete: Complete, encode: Encode, *, mode: str = "nltk", evolution_threshold: int = 100, now: str = "197001010000"):
        if mode not in parsers.MODES:
            raise ValueError(f"keyword pruning mode {mode!r}; use none, simple or nltk")
        self.complete, self.encode, self.mode, self.threshold, self.now = complete, encode, mode, evolution_threshold, now
        self.notes: list[Note] = []
        self.index = Vectors(encode)
        self.evolved = 0
        self.usage: list[tuple[int, int]] = []

    def _ask(self, prompt: str, schema: dict[str, Any]) -> dict[str, Any] | None:
        reply = str(self.complete(prompt, schema))
        self.usage.append((len(prompt.split()), len(reply.split())))
        return object_in(reply)

    def _analysed(self, content: str) -> dict[str, Any]:
        found = self._ask(ASK_ANALYSIS.format(content=content), ANALYSIS)
        if found is None:
            return {"keywords": [], "context": "General", "tags": []}
        kept = parsers.prune(content, found.get("keywords", []), self.mode) or parsers.prune(content, parsers.guessed_keywords(content), self.mode)
        context = found.get("context") or "General"
        return {"keywords": kept, "context": " ".join(context) if isinstance(context, list) else context, "tags": list(found.get("tags") or [])}

    def _shown(self, places: list[int]) -> str:
        lines = ((p, self.notes[p]) for p in places)
        return "".join(f"memory index:{p}\t talk start time:{n.timestamp}\t memory content: {n.content}\t memory context: {n.context}\t memory keywords: {n.keywords}\t memory tags: {n.tags}\n" for p, n in lines)

    def _evolve(self, note: Note) -> bool:
        places = self.index.search(note.content, NEIGHBOURS)
        prompt = ASK_EVOLUTION.format(context=note.context, content=note.content, keywords=note.keywords, count=len(places), neighbours=self._shown(places))
        said = self._ask(prompt, EVOLUTION) or {}
        if not said.get("should_evolve"):
            return False
        for action in said.get("actions", []):
            if action == "strengthen":
                note.links += said.get("suggested_connections", [])
                note.tags = list(said.get("tags_to_update", []))
            elif action == "update_neighbor":
                contexts = said.get("new_context_neighborhood", [])
                for k, (place, tags) in enumerate(zip(places, said.get("new_tags_neighborhood", []), strict=False)):
                    self.notes[place].tags = list(tags)
                    self.notes[place].context = contexts[k] if k < len(contexts) else self.notes[place].context
        return True

    @staticmethod
    def document(note: Note) -> str:
        """What is indexed of a new note."""
        return f"content:{note.content} context:{note.context} keywords: {', '.join(note.keywords)} tags: {', '.join(note.tags)}"

    @staticmethod
    def document_again(note: Note) -> str:
        """What is indexed of a note when all are indexed anew."""
        return f"{note.content} , {note.context} {' '.join(note.keywords)} {' '.join(note.tags)}"

    def add(self, content: str, timestamp: str | None = None, record_id: str = "") -> Note:
        found = self._analysed(content)
        note = Note(record_id, content, timestamp or self.now, found["keywords"], found["context"], found["tags"])
        evolved = self._evolve(note)
        self.notes.append(note)
        self.index.add(self.document(note))
        if evolved:
            self.evolved += 1
            if self.evolved % self.threshold == 0:
                self.index.again([self.document_again(n) for n in self.notes])
        return note

    def rows(self, sample_id: str) -> list[tuple]:
        out, n = [], len(self.notes)
        for pos, note in enumerate(self.notes):
            links = [self.notes[t].record_id if isinstance(t, int) and 0 <= t < n else str(t) for t in note.links]
            spent = [[u[k] for u in self.usage] if pos == 0 else [] for k in (0, 1)]
            out.append((sample_id, note.record_id, pos, note.content, note.timestamp, note.context, list(map(str, note.keywords)), list(map(str, note.tags)), links, len(self.usage), *spent, 0, [], [], None))
        return out


def build_notes(turns: DataFrame, model: Callable[[str], Complete], encode: Callable[[], Encode], **options: Any) -> DataFrame:
    """Notes of every sample, with the columns of `construct.build_notes`. model: makes a sample's `complete`; encode: makes the encoder, once for each task.

    A sample that fails is one row with an error and no record_id."""
    SchemaFold(lambda prompt, schema: "", lambda texts: [[0.0] for _ in texts], **options)  # wrong options are an error of the plan
    made: list[Encode] = []

    def fold(name: str, rows: list[dict[str, Any]]) -> list[tuple]:
        if not made:
            made.append(encode())
        state = SchemaFold(model(name), made[0], **options)
        for t in rows:
            state.add(t["text"] or "", t["timestamp"] if isinstance(t["timestamp"], str) else None, t["turn_id"])
        return state.rows(name)

    return by_sample(turns, fold)
