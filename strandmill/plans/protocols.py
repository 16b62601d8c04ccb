"""What a component of each family takes and gives. Implement one and register it to extend the engine."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession


class Dataset(Protocol):
    """samples, turns, questions and taxonomy of a file."""

    def __call__(self, spark: SparkSession, path: str) -> dict[str, DataFrame]: ...


class Chunker(Protocol):
    """Records of turns."""

    def __call__(self, turns: DataFrame) -> DataFrame: ...


class Construction(Protocol):
    """Notes or records of every sample, from its turns in order."""

    def __call__(self, turns: DataFrame, **options: Any) -> DataFrame: ...


class Retrieval(Protocol):
    """One pass over all questions: a plan with candidates and traces."""

    def __call__(self, questions: DataFrame, records: DataFrame, stages: list[Any]) -> Any: ...


class InteractiveRetrieval(Protocol):
    """Retrieval in turns with the answering model; reserved, no component has it."""

    def __call__(self, questions: DataFrame, records: DataFrame, answers: DataFrame) -> DataFrame: ...


class ContextLine(Protocol):
    """The text of one item."""

    def __call__(self, *columns: Any) -> Column: ...


class Answerer(Protocol):
    """A prediction, or the prompt for one."""

    def __call__(self, *columns: Column) -> Column: ...


class Metric(Protocol):
    """A score of prediction and reference."""

    def __call__(self, prediction: Column, reference: Column) -> Column: ...


class Provider(Protocol):
    """A client for a model: prompt and temperature give text, tokens and latency."""

    def __call__(self, llm: dict[str, Any]) -> Any: ...
