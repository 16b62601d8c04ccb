"""Models as column functions: texts in Arrow batches, the model loaded once for each worker process.

A model is named by a loader, a function without arguments that can be sent to workers; what it loads has `encode(texts)` (vectors) or
`predict(pairs)` (scores), as sentence encoders and cross-encoders have. Null texts count as empty."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 32
_LOADED: dict[str, Any] = {}


def held(name: str, load: Callable[[], Any]) -> Any:
    """The model of a name in this process."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def encoder(name: str, load: Callable[[], Any], *, normal: bool = True, batch: int = BATCH) -> Callable[[Column], Column]:
    """A function of a text column that gives its vectors, of length 1 with `normal`."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held(name, load)
        for texts in batches:
            rows = [x or "" for x in texts]
            parts = [np.asarray(model.encode(rows[k : k + batch]), float) for k in range(0, len(rows), batch)]
            vectors = np.concatenate(parts) if parts else np.empty((0, 0))
            if normal and len(vectors):
                vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(vectors))

    return run


def pair_scorer(name: str, load: Callable[[], Any], *, batch: int = BATCH) -> Callable[[Column, Column], Column]:
    """A function of two text columns that gives a score for each pair."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = held(name, load)
        for left, right in batches:
            pairs = [(a or "", b or "") for a, b in zip(left, right, strict=True)]
            yield pd.Series([float(x) for k in range(0, len(pairs), batch) for x in model.predict(pairs[k : k + batch])], dtype=float)

    return run


def sentence_encoder(model: str = "all-MiniLM-L6-v2") -> Callable[[Column], Column]:
    """An encoder of the sentence_transformers package, which has to be on the workers."""

    def load() -> Any:
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(model)

    return encoder(f"sentence:{model}", load)


def cross_encoder(model: str = "cross-encoder/ms-marco-MiniLM-L6-v2") -> Callable[[Column, Column], Column]:
    """A cross-encoder of the sentence_transformers package, which has to be on the workers."""

    def load() -> Any:
        from sentence_transformers import CrossEncoder

        return CrossEncoder(model)

    return pair_scorer(f"cross:{model}", load)
