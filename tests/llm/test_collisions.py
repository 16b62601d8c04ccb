"""Strings that hashes by sums modulo 2**64 cannot tell apart, whatever the base: a word in Thue-Morse order and its complement."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandmill.llm import jaccard, repetition
from strandmill.llm.textarrays import equal_spans, prefix_hash, slices, span_hash

SIZES = (1024, 2048, 4096)


def pair(n, a="a", b="b"):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_these_do_collide():
    x, y = pair(4096)
    data = np.frombuffer((x + y).encode(), np.uint8)
    a, b = span_hash(prefix_hash(data), np.array([0, 4096]), np.array([4096, 8192]))
    assert a == b
    assert equal_spans(data, np.array([0, 0, 5]), np.array([4096, 0, 5]), np.array([4096, 4096, 0]), most=100).tolist() == [False, True, True]


@pytest.mark.parametrize("n", SIZES)
def test_lines_and_words(spark, n):
    x, y = pair(n)
    rest = "one two three four five six seven eight nine ten"
    rows = repetition.features(frame(spark, [f"{x}\n{y}\n{rest}", f"{x}\n{x}\n{y}\n{rest}", f"{x} p q r s {y} p q r t {rest}", f"{x} p q r s {x} p q r s {rest}"])).orderBy("doc_id").collect()
    assert [r["n_dup_lines"] for r in rows] == [0, 1, 0, 0]
    assert [r["n_repeat_words"] for r in rows] == [0, 0, 0, 10]


def test_sorting_by_hash_alone_would_fail():
    x, y = pair(1024)
    part = next(slices(pa.table({"text": [f"{y}\n{x}\n{y}\n{x}\n{x}\nend"]}).to_batches()))
    assert repetition._duplicate_lines(part).tolist() == [3]


@pytest.mark.parametrize("n", SIZES)
def test_shingles(spark, n):
    x, y = pair(n)
    docs = frame(spark, [f"{x} p q r s", f"{y} p q r s", f"{x} p q r s"])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs).collect()}
    assert found == {0: (1, 0), 1: (1, 1), 2: (1, 0)}
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1]
    counted = {r["doc_id"]: (r["rep"], r["n_links"]) for r in jaccard.link_counts(docs).collect()}
    assert counted == {0: (0, 0), 1: (1, 0), 2: (0, 0)}


def test_no_links_of_no_rows(none):
    assert jaccard.link_counts(none).collect() == []
