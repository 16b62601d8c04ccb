"""Model providers over HTTP: one call for each row, in Arrow batches, with usage; errors are values.

A provider is a description (`Wire`): where its request goes, what the request holds, and where text and token counts stand in the reply.
Tasks may run again, so a plan that calls a provider is written before it is read twice.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions.parsers import empty_object, outer_object

#: Column types of a reply, as pandas holds them, so that a batch without a single reply has the same types.
REPLY = {"text": "string", "prompt_tokens": "Int64", "completion_tokens": "Int64", "total_tokens": "Int64", "source": "string", "latency_ms": "Float64", "error": "string"}
SCHEMA = "text string, prompt_tokens long, completion_tokens long, total_tokens long, source string, latency_ms double, error string"
TIMEOUT = 120


def with_retries(call: Callable[..., Any], retries: int = 2, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """Calls again after 1, 2, 4, ... times the delay; the last error is raised."""

    def run(*args: Any, **kwargs: Any) -> Any:
        for attempt in range(retries + 1):
            try:
                return call(*args, **kwargs)
            except Exception:
                if attempt == retries:
                    raise
                sleep(delay * 2**attempt)
        return None

    return run


def _chat(model: str, prompt: str, options: dict[str, Any]) -> dict[str, Any]:
    return {"model": model, "messages": [{"role": "user", "content": prompt}], **options}


@dataclass(frozen=True)
class Wire:
    """`body` makes the request from model, prompt and options; the paths lead to the values of the reply; `schema` puts a JSON schema into the options."""

    path: str
    body: Callable[[str, str, dict[str, Any]], dict[str, Any]]
    text: tuple[str | int, ...]
    asked: tuple[str | int, ...]
    answered: tuple[str | int, ...]
    schema: Callable[[dict[str, Any]], dict[str, Any]]
    base: str | None = None  # None: host and port of the parameters
    root: str = ""


_CHAT_REPLY = {"text": ("choices", 0, "message", "content"), "asked": ("usage", "prompt_tokens"), "answered": ("usage", "completion_tokens"), "schema": lambda s: {"response_format": {"type": "json_schema", "json_schema": {"name": "reply", "schema": s, "strict": True}}}}
#: The servers' paths, field names and default places.
WIRES = {
    "ollama": Wire("/api/chat", lambda model, prompt, options: _chat(model, prompt, {"stream": False, **({"format": options.pop("format")} if "format" in options else {}), "options": options}), ("message", "content"), ("prompt_eval_count",), ("eval_count",), lambda s: {"format": s}, "http://localhost:11434"),
    "sglang": Wire("/generate", lambda model, prompt, options: {"text": prompt, "sampling_params": options}, ("text",), ("prompt_tokens",), ("completion_tokens",), lambda s: {"json_schema": json.dumps(s)}),
    "openai": Wire("/chat/completions", _chat, base="https://api.openai.com/v1", **_CHAT_REPLY),
    "vllm": Wire("/chat/completions", _chat, root="/v1", **_CHAT_REPLY),
    "litellm": Wire("/chat/completions", _chat, base="http://localhost:4000", **_CHAT_REPLY),
}
PROVIDERS = ("fake", *sorted(WIRES))


def _found(reply: Any, path: tuple[str | int, ...]) -> Any:
    for step in path:
        if reply is None:
            return None
        reply = reply[step] if isinstance(step, int) else reply.get(step)
    return reply


def _request(llm: dict[str, Any], prompt: str, temperature: float | None, schema: dict[str, Any] | None = None) -> urllib.request.Request:
    """The request of one completion. Parameters that say where and who are taken out; the others are options."""
    wire, options = WIRES[llm["provider"]], dict(llm["params"])
    host, port, key = options.pop("host", "http://localhost"), int(options.pop("port", 30000)), options.pop("api_key", None)
    place = options.pop("base_url", None) or wire.base or f"{host}:{port}{wire.root}"
    if llm["provider"] == "openai":
        key = key or os.environ.get("OPENAI_API_KEY")
        if not key:
            raise ValueError("openai needs an api_key")
    options |= ({} if temperature is None else {"temperature": temperature}) | (wire.schema(schema) if schema else {})
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    return urllib.request.Request(place.rstrip("/") + wire.path, json.dumps(wire.body(llm["model"], prompt, options)).encode(), headers)


def _over_http(llm: dict[str, Any], prompt: str, temperature: float | None, schema: dict[str, Any] | None = None) -> tuple[str, int | None, int | None]:
    wire = WIRES[llm["provider"]]
    with urllib.request.urlopen(_request(llm, prompt, temperature, schema), timeout=TIMEOUT) as answer:
        reply = json.load(answer)
    return str(_found(reply, wire.text) or ""), _found(reply, wire.asked), _found(reply, wire.answered)


def _call(llm: dict[str, Any], prompt: str, temperature: float | None, schema: dict[str, Any] | None = None) -> tuple[str, int | None, int | None]:
    if llm["provider"] == "fake":
        return str(llm["params"].get("response", "")), None, None
    return _over_http(llm, prompt, temperature, schema)


def client(llm: dict[str, Any]) -> Callable[[str, float | None], dict[str, Any]]:
    """A function of prompt and temperature that gives text, tokens and latency. Unreported tokens are counted as words."""
    if llm["provider"] not in PROVIDERS:
        raise ValueError(f"unknown llm_provider {llm['provider']!r}; available: {', '.join(PROVIDERS)}")

    def ask(prompt: str, temperature: float | None = None) -> dict[str, Any]:
        began = time.perf_counter()
        text, asked, answered = _call(llm, prompt, temperature)
        reported = asked is not None and answered is not None
        if not reported:
            asked, answered = len(prompt.split()), len(text.split())
        return {"text": text, "prompt_tokens": asked, "completion_tokens": answered, "total_tokens": asked + answered, "source": "reported" if reported else "estimated", "latency_ms": (time.perf_counter() - began) * 1000, "error": None}

    return ask


def structured(llm: dict[str, Any], schema: dict[str, Any], retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], dict[str, Any]]:
    """Completions that are objects of a JSON schema; one that fails, or is no object, is the schema's empty object."""
    ask = with_retries(lambda prompt: _call(llm, prompt, None, schema)[0], retries, sleep=sleep)

    def complete(prompt: str) -> dict[str, Any]:
        try:
            return outer_object(ask(prompt)) or empty_object(schema)
        except Exception:  # noqa: BLE001
            return empty_object(schema)

    return complete


def reachable(llm: dict[str, Any]) -> bool:
    """Whether the provider answers a short prompt."""
    try:
        _call(llm, "Hello", None)
    except Exception:  # noqa: BLE001
        return False
    return True


def completed(llm: dict[str, Any], prompt: Column, temperature: Column | None = None) -> Column:
    """A struct of SCHEMA for each row; an error leaves the rest null, a null prompt leaves all null and calls nothing."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ask = client(llm)
        for prompts, heats in batches:
            rows = []
            for p, t in zip(prompts, heats, strict=True):
                try:
                    rows.append(ask(p, None if pd.isna(t) else float(t)) if isinstance(p, str) else {})
                except Exception as e:  # noqa: BLE001  an error is a value of its row
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame({name: pd.array([r.get(name) for r in rows], kind) for name, kind in REPLY.items()})

    return run(prompt, F.lit(None).cast("double") if temperature is None else temperature.cast("double"))
