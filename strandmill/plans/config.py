"""Experiment files: a strict tree, described once as data and checked against it."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from strandmill.plans.registry import catalog

NEEDED = object()


@dataclass(frozen=True)
class Field:
    """What a value may be: `kind` names it (text, whole, flag, any, texts, wholes, map, one of a tuple, a tree, or a list of a tree)."""

    kind: Any
    default: Any = NEEDED
    least: int | None = None
    pattern: str | None = None


PARTS = {"adapter": Field("text"), "params": Field("map", {})}
LLM = {"provider": Field(("fake", "openai", "ollama", "sglang", "vllm")), "model": Field("text"), "params": Field("map", {})}
SELECTION = {"sample_ids": Field("texts", None), "question_ids": Field("texts", None), "sample_limit": Field("whole", None, 1), "turn_limit": Field("whole", None, 1), "question_limit": Field("whole", None, 1), "categories": Field("texts", None)}
STAGE = PARTS | {"top_k": Field("whole", 10, 1), "llm": Field(LLM, None), "query": Field(("current", "original_question"), "current")}
CONSTRUCTION = PARTS | {"runs": Field("whole", 1, 1), "chunker": Field(PARTS, None), "selection": Field(SELECTION, {}), "llm": Field(LLM, None)}
EVALUATION = {
    "runs": Field("whole", 1, 1), "retrieval": Field(PARTS | {"stages": Field([STAGE], [])}), "context": Field(PARTS | {"fields": Field("texts", ["timestamp", "content", "keywords"])}),
    "qa": Field(PARTS | {"llm": Field(LLM, None)}), "metrics": Field([PARTS], []), "selection": Field(SELECTION, {}),
    "memory_source": Field({"experiment_id": Field("text"), "construction_runs": Field("runs", "all")}, None),
}
TREE = {
    "experiment": Field({"id": Field("text", pattern=r"[A-Za-z0-9][A-Za-z0-9_.-]*"), "description": Field("text", None), "tags": Field("texts", [])}),
    "pipeline": Field({"stages": Field("phases"), "dataset": Field(PARTS | {"path": Field("text")}), "construction": Field(CONSTRUCTION, None), "retrieve_qa": Field(EVALUATION, None)}),
    "runtime": Field({"artifact_root": Field("text", "artifacts/experiments"), "max_workers": Field("whole", 1, 1), "resume": Field("flag", False), "on_error": Field(("stop", "continue"), "stop"), "seed": Field("whole", 0)}, {}),
}


class ConfigError(ValueError):
    pass


def _value(field: Field, value: Any, at: str) -> Any:
    kind = field.kind
    if isinstance(kind, dict):
        return _tree(kind, value, at)
    if isinstance(kind, list):
        if not isinstance(value, (list, tuple)):
            raise ConfigError(f"{at}: a list is expected")
        return [_tree(kind[0], v, f"{at}[{k}]") for k, v in enumerate(value)]
    texts = isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value)
    wholes = isinstance(value, (list, tuple)) and all(isinstance(v, int) and not isinstance(v, bool) for v in value)
    good = {
        "text": isinstance(value, (str, Path)), "whole": isinstance(value, int) and not isinstance(value, bool), "flag": isinstance(value, bool), "map": isinstance(value, dict),
        "texts": texts, "runs": value == "all" or wholes, "phases": texts and all(v in ("construction", "retrieve_qa") for v in value),
    }.get(kind, value in kind if isinstance(kind, tuple) else True)
    if not good:
        raise ConfigError(f"{at}: {value!r} is not {'one of ' + ', '.join(kind) if isinstance(kind, tuple) else kind}")
    if field.least is not None and value < field.least:
        raise ConfigError(f"{at}: at least {field.least}")
    if field.pattern and not re.fullmatch(field.pattern, str(value)):
        raise ConfigError(f"{at}: {value!r} does not fit {field.pattern}")
    return str(value) if kind == "text" else list(value) if isinstance(value, tuple) else value


def _tree(fields: dict[str, Field], value: Any, at: str) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise ConfigError(f"{at or 'file'}: a mapping is expected")
    if extra := sorted(map(str, set(value) - set(fields))):
        raise ConfigError(f"{at or 'file'}: unknown key {extra[0]}")
    out = {}
    for name, field in fields.items():
        here = f"{at}.{name}".lstrip(".")
        if value.get(name) is None:
            if field.default is NEEDED:
                raise ConfigError(f"{here}: missing")
            out[name] = _tree(field.kind, {}, here) if field.default == {} and isinstance(field.kind, dict) else field.default
        else:
            out[name] = _value(field, value[name], here)
    return out


def _models(tree: Any) -> list[dict[str, Any]]:
    if isinstance(tree, dict):
        own = [tree] if set(tree) == set(LLM) else []
        return own + [m for v in tree.values() for m in _models(v)]
    return [m for v in tree for m in _models(v)] if isinstance(tree, list) else []


def _check(tree: dict[str, Any]) -> None:
    """Rules between parts of the tree."""
    pipeline = tree["pipeline"]
    phases, build, evaluate = pipeline["stages"], pipeline["construction"], pipeline["retrieve_qa"]
    for wrong, why in (
        (not phases, "pipeline.stages needs a stage"),
        (len(set(phases)) < len(phases), "duplicate pipeline stage"),
        ("construction" in phases and build is None, "the construction stage needs pipeline.construction"),
        ("retrieve_qa" in phases and evaluate is None, "the retrieve_qa stage needs pipeline.retrieve_qa"),
        (phases == ["retrieve_qa"] and evaluate is not None and evaluate["memory_source"] is None, "without construction, retrieve_qa needs memory_source"),
        (build is not None and build["adapter"] == "turn_rag" and build["chunker"] is None, "turn_rag needs a chunker"),
        (build is not None and build["adapter"] == "amem" and build["llm"] is None, "amem needs an llm"),
        (evaluate is not None and not evaluate["retrieval"]["stages"], "retrieval needs a stage"),
        (evaluate is not None and evaluate["qa"]["adapter"] == "robust" and evaluate["qa"]["llm"] is None, "robust qa needs an llm"),
    ):
        if wrong:
            raise ConfigError(why)
    for model in _models(tree):
        most = model["params"].get("max_tokens")
        if most is not None and (isinstance(most, bool) or not isinstance(most, int) or most < 1):
            raise ConfigError("llm.params.max_tokens is a positive whole number")
    held = catalog()
    used = [("dataset", pipeline["dataset"])]
    used += [("construction", build)] + ([("chunker", build["chunker"])] if build["chunker"] else []) if build else []
    if evaluate:
        used += [("retrieval", evaluate["retrieval"]), ("context", evaluate["context"]), ("qa", evaluate["qa"])]
        used += [("retrieval_stage", s) for s in evaluate["retrieval"]["stages"]] + [("metric", m) for m in evaluate["metrics"]]
    for family, part in used:
        held[family].get(part["adapter"])


def validated(tree: Any) -> dict[str, Any]:
    """The tree with its defaults; a ConfigError names what is wrong."""
    out = _tree(TREE, tree, "")
    _check(out)
    return out


def load(path: str | Path) -> dict[str, Any]:
    import yaml

    return validated(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def _without_none(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _without_none(v) for k, v in value.items() if v is not None}
    return [_without_none(v) for v in value] if isinstance(value, list) else value


def fingerprint(tree: dict[str, Any]) -> str:
    """SHA-256 of the tree without nulls, as sorted compact JSON."""
    return hashlib.sha256(json.dumps(_without_none(tree), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
