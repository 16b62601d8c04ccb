"""Keyword pruning and completion parsing as vectorised UDFs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions import parsers, porter


def pruned(content: Column, keywords: Column, mode: str = "nltk", most: int = 5) -> Column:
    if mode not in parsers.MODES:
        raise ValueError(f"keyword pruning mode {mode!r}; use none, simple or nltk")

    @F.pandas_udf("array<string>")
    def run(c: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([parsers.prune(x or "", [] if y is None else list(y), mode, most) for x, y in zip(c, k, strict=True)])

    return run(content, keywords)


def stemmed(word: Column) -> Column:
    @F.pandas_udf("string")
    def run(w: pd.Series) -> pd.Series:
        return w.map(lambda x: None if x is None else porter.stem(x))

    return run(word)


def analysed(response: Column, content: Column, mode: str = "nltk") -> Column:
    @F.pandas_udf("keywords array<string>, context string, tags array<string>")
    def run(r: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{k: v for k, v in parsers.analysis(x or "", y or "", mode).items() if k in ("keywords", "context", "tags")} for x, y in zip(r, c, strict=True)], columns=["keywords", "context", "tags"])

    return run(response, content)


def decided(response: Column) -> Column:
    @F.pandas_udf("decision string, reason string")
    def run(r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{k: str(v) for k, v in parsers.decision(x or "").items() if k in ("decision", "reason")} for x in r], columns=["decision", "reason"])

    return run(response)


def through(kind: str, function: Callable[..., dict[str, Any]], *columns: Column) -> Column:
    """A plain function of one or two texts (null as an empty text) over batches; its dict becomes the struct `kind`, of which it may leave fields out."""
    names, count = [c.split()[0] for c in kind.split(", ")], len(columns)

    @F.pandas_udf(kind)
    def run(first: pd.Series, second: pd.Series) -> pd.DataFrame:
        rows = [function(*(x or "" for x in (a, b)[:count])) for a, b in zip(first, second, strict=True)]
        return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    return run(columns[0], columns[-1])
