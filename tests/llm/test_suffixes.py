import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import shared, suffixes
from tests.llm.conftest import prose


def brute(rows, threshold):
    """(id, text) -> kept bytes, by the definition."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - threshold + 1) if i is not None else ():
            w = b[p : p + threshold]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - threshold + 1) if i is not None else ():
            if first[b[p : p + threshold]] < i:
                gone[p : p + threshold] = b"\x01" * threshold
        out.append((i, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bucket", "salts"), [(1_000_000, 1), (700, 1), (60, 3)])
def test_equals_brute_force(docs, nasty_rows, bucket, salts):
    found = suffixes.spans(docs, bucket_windows=bucket, salts=salts)
    removed = F.aggregate(F.zip_with("span_start", "span_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    rows = [tuple(r) for r in found.select("doc_id", "n_bytes", removed, F.sha2("kept", 256)).collect()]
    assert sorted(rows, key=str) == brute([(r[0], r[1]) for r in nasty_rows], 50)


def test_hot_minimizers_do_not_change_results(docs, nasty_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "SAMPLE_ONE_IN", 1)
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    assert len(suffixes.hot_grams(rows, 50, 12, 100)) > 0
    found = suffixes.spans(docs, bucket_windows=100).select("doc_id", "n_bytes", F.sha2("kept", 256))
    assert sorted(((a, b, d) for a, b, _, d in brute([(r[0], r[1]) for r in nasty_rows], 50)), key=str) == sorted((tuple(r) for r in found.collect()), key=str)


def test_groups_are_those_of_the_byte_order():
    """The passes leave the suffixes that are equal to one of another text, sorted by their bytes."""
    rng = np.random.default_rng(1)
    for alphabet in (2, 3, 250):
        data = rng.integers(0, alphabet, 4000).astype(np.uint8)
        data[2000:2200] = data[100:300]
        data[3000:3060] = data[150:210]
        for depth in (1, 7, 8, 9, 50):
            starts = np.arange(len(data) - depth + 1)
            ids = starts // 500
            text = [data[s : s + depth].tobytes() for s in starts]
            by = {}
            for t, i in zip(text, ids.tolist(), strict=True):
                by.setdefault(t, set()).add(i)
            alive, cuts = suffixes.equal_groups(data, starts, ids, depth)
            assert sorted(alive.tolist()) == [k for k, t in enumerate(text) if len(by[t]) > 1]
            order = [text[k] for k in alive]
            assert order == sorted(order) and [k for k in range(len(order)) if k == 0 or order[k] != order[k - 1]] == cuts.tolist()


@pytest.mark.parametrize("salts", [1, 4])
def test_a_window_in_every_document(spark, monkeypatch, salts):
    """A hot passage, most of a hot text, large ids, and a window that stands many times in one text."""
    monkeypatch.setattr(suffixes, "SAMPLE_ONE_IN", 1)
    rng = random.Random(8)
    line = prose(rng, 20)
    rows = [(2**62 + 5 + k % 190, f"{prose(rng, 8)} {line} {prose(rng, 4)}") for k in range(200)] + [(-(2**63), line), (2**63 - 1, line * 9), (7, "ab" * 300), (8, "ab" * 60)]
    rows += [rows[3]] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = suffixes.spans(frame, bucket_windows=200, salts=salts).select("doc_id", "n_bytes", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(((a, b, d) for a, b, _, d in brute(rows, 50)), key=str)


def test_a_long_text_in_pieces(docs, nasty_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 1 << 12)
    import pyarrow as pa

    from strandmill.llm.textarrays import slices

    text = "".join(chr(97 + (k * k) % 23) for k in range(10000))
    (part,) = slices([pa.record_batch({"text": pa.array([text])})])
    starts = [base + s + np.arange(c) for data, offsets, base in suffixes._pieces(part, 50) for s, c in zip(*suffixes.strings_of(data, offsets, 50, 12)[1:3], strict=True)]
    assert np.array_equal(np.sort(np.concatenate(starts)), np.arange(10000 - 49))


def test_cut_keeps_columns_and_drops_what_is_wholly_repeated(docs, none):
    found = suffixes.cut(docs)
    assert found.columns == docs.columns and found.where("doc_id IS NULL").count() == 1
    assert found.where("doc_id = 6").count() == 0 and found.where("doc_id = 5").count() == 1 and found.where("doc_id = 1").count() == 1
    assert suffixes.cut(none).count() == 0 and suffixes.spans(none).count() == 0


@pytest.mark.parametrize("salts", [1, 3])
def test_passes_do_not_change_results(docs, nasty_rows, monkeypatch, salts):
    """Minimizers dealt with in several passes over the texts."""
    monkeypatch.setattr(suffixes, "SAMPLE_ONE_IN", 1)
    monkeypatch.setattr(suffixes, "PASS_BUCKETS", 40)
    found = suffixes.spans(docs, bucket_windows=300, salts=salts).select("doc_id", "n_bytes", F.sha2("kept", 256))
    assert sorted(((a, b, d) for a, b, _, d in brute([(r[0], r[1]) for r in nasty_rows], 50)), key=str) == sorted((tuple(r) for r in found.collect()), key=str)


def test_blobs_do_not_grow_as_slices_times_buckets(spark):
    """Neighbouring buckets travel together and are settled together: what goes back is one blob for each shelf and group of documents."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(400)]
    texts = [" ".join(rng.choice(words[i % 40 * 10 : i % 40 * 10 + 20], 90)) for i in range(300)]
    texts += [texts[i][20:300] + str(i) for i in range(0, 300, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "0L AS variant", "text").repartition(4)
    total, groups, window = sum(map(len, texts)), 3, 600
    buckets = -(-total // window)
    assert buckets > 4 * suffixes.SHELVES
    with shared.scratch(spark):
        found = suffixes.repeats(shared.Tables(spark, "suffixes"), docs, groups, threshold=50, gram=12, bucket_windows=window, total=total, salts=1)
        n = found.where("bucket >= 0").count()
    shelves = -(-buckets // suffixes.shelf_width(buckets))
    assert 0 < n <= groups * (2 * shelves + 4)  # cold and hot shelves, and what the four tasks settle at once
