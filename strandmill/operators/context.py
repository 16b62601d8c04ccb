"""Contexts, documents for indexes, prompts and answers as columns and ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.text import first_line, flip, strip


def _list_repr(items: Column) -> Column:
    """A list of texts as Python prints it (texts without quotes or backslashes)."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def line(fields: Sequence[str], arrays: Sequence[str] = ("keywords", "evidence_refs")) -> Column:
    """The fields of an item joined by " | "; null, empty and () are left out; lists print as lists."""
    values = [F.when(F.size(f) > 0, _list_repr(F.col(f))) if f in arrays else F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields]
    return F.concat_ws(" | ", *values)


def graph_lines(timestamp: Column, content: Column, context: Column, keywords: Column, tags: Column) -> Column:
    """Five labelled lines of a note."""
    return F.concat(
        F.lit("talk start time:"), F.coalesce(timestamp, F.lit("")), F.lit("\nmemory content: "), F.coalesce(content, F.lit("")), F.lit("\nmemory context: "), F.coalesce(context, F.lit("")),
        F.lit("\nmemory keywords: "), F.array_join(keywords, ", "), F.lit("\nmemory tags: "), F.array_join(tags, ", "),
    )


def rerank_text(timestamp: Column, content: Column, context: Column, keywords: Column, tags: Column) -> Column:
    return F.concat(
        F.lit("talk start time: "), F.coalesce(timestamp, F.lit("None")), F.lit("\nmemory content: "), content, F.lit("\nmemory context: "), context,
        F.lit("\nmemory keywords: "), F.array_join(keywords, ", "), F.lit("\nmemory tags: "), F.array_join(tags, ", "),
    )


def index_document(context: Column, keywords: Column) -> Column:
    """What the note index holds: context and keywords, not the content."""
    return strip(F.concat(context, F.lit(" keywords: "), F.array_join(keywords, ", ")))


def legacy_document(kind: str, content: Column, context: Column, keywords: Column, tags: Column) -> Column:
    """What three older indexes held of a note: `add` when it came, `rebuild` when the index was made anew, `hybrid` its keywords only."""
    listed, spaced = F.array_join(keywords, ", "), lambda x: F.array_join(x, " ")
    kinds = {
        "add": lambda: F.concat(F.lit("content:"), content, F.lit(" context:"), context, F.lit(" keywords: "), listed, F.lit(" tags: "), F.array_join(tags, ", ")),
        "rebuild": lambda: F.concat(content, F.lit(" , "), context, F.lit(" "), spaced(keywords), F.lit(" "), spaced(tags)),
        "hybrid": lambda: listed,
    }
    if kind not in kinds:
        raise ValueError(f"legacy documents are of {', '.join(kinds)}, not {kind!r}")
    return kinds[kind]()


def neighbour_line(index: Column, timestamp: Column, content: Column, context: Column, keywords: Column, tags: Column) -> Column:
    return F.concat(
        F.lit("memory index:"), index.cast("string"), F.lit("\t talk start time:"), timestamp, F.lit("\t memory content: "), content, F.lit("\t memory context: "), context,
        F.lit("\t memory keywords: "), _list_repr(keywords), F.lit("\t memory tags: "), _list_repr(tags), F.lit("\n"),
    )


def joined(items: DataFrame, text: Column, keys: Sequence[str] = ("question_id",), rank: str = "rank", separator: str = "\n") -> DataFrame:
    """keys, context_text, item_ids: the items' texts in rank order. A question has at most its stages' top k items and their neighbours."""
    rows = items.select(*keys, F.struct(F.col(rank), text.alias("line"), F.col("record_id")).alias("_i"))
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_i")).alias("_all"))
    return held.select(*keys, F.array_join(F.transform("_all", lambda x: x["line"]), separator).alias("context_text"), F.transform("_all", lambda x: x["record_id"]).alias("item_ids"))


def extractive(context_text: Column) -> Column:
    return first_line(context_text)


def qa_prompt(question_id: Column, question: Column, reference: Column, label: Column, context: Column, seed: int = 0) -> Column:
    """The answering prompt by question type."""
    head = F.concat(F.lit("Based on the context: "), context)
    none = F.lit("Not mentioned in the conversation")
    odd = flip(seed, question_id)
    first, second = F.when(odd, reference).otherwise(none), F.when(odd, none).otherwise(reference)
    adversarial = F.concat(head, F.lit(", answer the following question. "), question, F.lit("\n\nSelect the correct answer: "), first, F.lit(" or "), second, F.lit("  Short answer:"))
    temporal = F.concat(head, F.lit(", answer the following question. Use DATE OF CONVERSATION to answer with an approximate date.\nPlease generate the shortest possible answer, using words from the conversation where possible, and avoid using any subjects.\n\nQuestion: "), question, F.lit(" Short answer:"))
    other = F.concat(head, F.lit(", write an answer in the form of a short phrase for the following question. Answer with exact words from the context whenever possible.\n\nQuestion: "), question, F.lit(" Short answer:"))
    return F.when(label == "adversarial", adversarial).when(label == "temporal", temporal).otherwise(other)


def qa_temperature(label: Column, adversarial: float = 0.5) -> Column:
    return F.when(label == "adversarial", adversarial).otherwise(0.7)
