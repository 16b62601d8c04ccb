"""Registered queries against their SQL, and the contract of columns."""

import pytest

from strandmill.llm import registry
from tests.conftest import TINY


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, same_rows, name):
    same_rows(registry.QUERIES[name](spark, TINY), registry.SQL[name])


@pytest.mark.parametrize(("name", "columns"), [
    ("op5_quality_rules", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"), ("op7_bpe", "doc_id n_tokens ids_sha256 decoded_sha256"),
    ("op12_tokenizer_alignment", "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"),
    ("op8_language_id", "doc_id held_out lang_pred score"), ("op9_quality_classifier", "doc_id perplexity kept"),
])
def test_one_row_for_each_document(spark, name, columns):
    found = registry.QUERIES[name](spark, TINY)
    assert set(columns.split()) <= set(found.columns)
    rows = [r["doc_id"] for r in found.collect()]
    assert sorted(rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id").collect())


def test_all_operators_and_the_pipeline():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_long_dialogues_meet_their_speakers_in_blocks(spark, monkeypatch):
    """The same rows, however many parts meet the speakers together."""
    from strandmill.llm import chat

    rows = [("a", k, ["user", "assistant", "system", None][k % 4], f"t{k}") for k in range(203)] + [("b", 0, "user", "x")] * 9 + [("c", 0, "system", "only")] + [(None, 1, "user", "y")]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found = []
    for together in (1, 3, 64):
        monkeypatch.setattr(chat, "PARTS_TOGETHER", together)
        found.append(sorted(map(str, chat.rotate(frame, part_turns=4).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 2 * 51 + 3
