"""Queries of this folder and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import alignment, bpe, chat, codebooks, decontaminate, jaccard, language, licences, perplexity, pivots, repetition, suffixes, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_chat_rotation": chat.op3_chat_rotation,
    "op4_licence_scan": licences.op4_licence_scan,
    "op5_quality_rules": repetition.op5_quality_rules,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "jaccard_links": jaccard.jaccard_links,
    "op7_bpe": bpe.op7_bpe,
    "op8_language_id": language.op8_language_id,
    "op9_quality_classifier": perplexity.op9_quality_classifier,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_pivot_dedup": pivots.op11_pivot_dedup,
    "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
    "op13_heap_lloyd": codebooks.op13_heap_lloyd,
}

#: The others can't be said in SQL, or not in useful time; tests/llm holds them against brute force.
SQL: dict[str, str] = {
    "op1_url_filter": urls.OP1_SQL,
    "op2_suffix_dedup": suffixes.OP2_SQL,
    "op3_chat_rotation": chat.OP3_SQL,
    "op4_licence_scan": licences.OP4_SQL,
    "op5_quality_rules": repetition.OP5_SQL,
    "op6_jaccard_join": jaccard.OP6_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_pivot_dedup": pivots.OP11_SQL,
    "op13_heap_lloyd": codebooks.OP13_SQL,
}
