"""Stand-ins for models in the catalogue's queries: they read their answers off the prompt."""

from __future__ import annotations

import json
import re
from typing import Any


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A small encoder: how often each letter is in a text."""
    return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def schema_model(sample_id: str):
    """Replies as objects, some of them wrapped in other text, and one in seven broken. What it does goes by the numbers of the nearest notes and of the new note's letters."""

    def complete(prompt: str, schema: dict[str, Any]) -> str:
        if "keywords" in schema["properties"]:
            content = prompt.rsplit("Text:\n", 1)[1]
            words = sorted(set(re.findall(r"[a-z]{4,}", content.lower())))[:4]
            return f"Here: {json.dumps({'keywords': words, 'context': ' '.join(['about', *words[:2]]), 'tags': words[:2]})} done"
        places = [int(p) for p in re.findall(r"memory index:(\d+)", prompt)]
        size = len(re.search(r"content: (.*?)\nkeywords:", prompt, re.S)[1])
        if size % 7 == 6:
            return "no object"
        actions = [a for bit, a in ((1, "strengthen"), (2, "update_neighbor")) if size & bit]
        changed = places[: 1 + size % 3]
        return json.dumps({"should_evolve": bool(places), "actions": actions, "suggested_connections": places[:2], "tags_to_update": ["linked", str(size % 5)], "new_context_neighborhood": [f"seen {p}" for p in changed[:1]], "new_tags_neighborhood": [[f"t{p}"] for p in changed]})

    return complete
