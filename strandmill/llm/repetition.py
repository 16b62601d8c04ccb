"""Quality rules on repetition: a suffix array of the words of each text.

Words are `[^\\x20\\x09-\\x0D]+`. The suffixes of all texts of a slice are sorted together by
prefix doubling, with the text as the first key, so suffixes of different texts never
meet; only groups that are still tied are sorted again. The longest common prefix of neighbours
comes from the ranks of each doubling. A suffix's longest match is the larger of its two
neighbours' values; the spans these matches cover, unioned, are the maximal repeated substrings. Words and lines are told apart by
their bytes: hashes only sort them, and equal hashes of different bytes are found and set right.

A text is rejected if it fails a base rule (fewer than `MIN_WORDS` words, or more than 20 % of its
words in repeated 5-word windows), if repeats of at least `MIN_REPEAT` words cover more than
`MAX_COVERED` of its words, or if its longest repeat has more than `MAX_LONGEST` words.

Defined results: a null, empty or blank text has no words, zero features and is not kept; repeated
rows are judged alike; an empty table gives no rows. `keep_clean` passes all input columns through,
whatever their names. Memory: one slice of texts at a time (2 MB, or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.textarrays import SPACED, Slice, Words, equal_spans, mix, prefix_hash, slices, span_hash, sums, trim, words_of

MIN_WORDS = 10
BASE_WINDOW = 5
MAX_BASE_PERCENT = 20
MIN_REPEAT = 10
MAX_COVERED = 0.15
MAX_LONGEST = 100

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80

FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_fraction double, longest_repeat long, base_failed boolean, kept boolean"


def told_apart(data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The keys, where those of different spans are made different: spans of one key are held against the first of them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    again = np.flatnonzero(np.concatenate([[False], ordered[1:] == ordered[:-1]])) if len(keys) else np.empty(0, np.int64)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), np.arange(len(keys)), 0))[again] if len(keys) else again
    a, b = order[first], order[again]
    length = end - start
    same = length[a] == length[b]
    same[same] = equal_spans(data, start[a][same], start[b][same], length[a][same])
    if same.all():
        return keys
    out = keys.copy()
    wrong = np.isin(keys, keys[b[~same]])
    number: dict[bytes, int] = {}
    for k in np.flatnonzero(wrong).tolist():
        out[k] = mix(keys[k : k + 1] + np.uint64(number.setdefault(data[start[k] : end[k]].tobytes(), len(number) + 1)))[0]
    return out


def longest_matches(words: Words) -> np.ndarray:
    """For each word, the longest run of words from it that also starts elsewhere in its text."""
    n = len(words.start)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    owner = words.owner()
    end = words.cuts[1:][owner]
    keys = mix(words.hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, length = [rank.copy()], 1
    tied = order[~(fresh & np.concatenate([fresh[1:], [True]]))]
    ever = tied
    while len(tied):
        beyond = tied + length
        second = np.where(beyond < end[tied], rank[np.minimum(beyond, n - 1)] + 1, 0)
        group = rank[tied]
        by = np.lexsort((second, group))
        tied, group, second = tied[by], group[by], second[by]
        at = np.arange(len(tied))
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        rank[tied] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        levels.append(rank.copy())
        length *= 2
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
    if not len(ever):
        return out
    chain = ever[np.argsort(rank[ever])]
    a, b = chain[:-1], chain[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same * (1 << k)
    common[owner[a] != owner[b]] = 0
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    depth = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(depth[:n]) > 0


def _duplicate_lines(part: Slice) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of their text."""
    n = len(part.data)
    if not n:
        return np.zeros(len(part), np.int64)
    ends = np.flatnonzero(part.data == 10)
    starts = np.unique(np.concatenate([ends + 1, part.offsets[:-1]]))
    starts = starts[starts < n]
    stops = np.minimum(np.append(starts[1:], n), n)
    stops = stops - ((stops > starts) & (part.data[np.maximum(stops - 1, 0)] == 10))
    filled = np.concatenate([[0], np.cumsum(SPACED[part.data])])
    worded = filled[stops] > filled[starts]
    starts, stops = starts[worded], stops[worded]
    owner = np.searchsorted(part.offsets, starts, "right") - 1
    hashes = told_apart(part.data, starts, stops, span_hash(prefix_hash(part.data), starts, stops))
    keys = mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    again = np.concatenate([[False], keys[order][1:] == keys[order][:-1]]) if len(keys) else np.empty(0, bool)
    return np.bincount(owner[order][again], minlength=len(part)).astype(np.int64)


def judge(part: Slice) -> dict[str, np.ndarray]:
    words = words_of(part.data, part.offsets, SPACED)
    words.hashes = told_apart(part.data, words.start, words.end, words.hashes)
    count = np.diff(words.cuts)
    match = longest_matches(words)
    n = len(match)
    five = np.flatnonzero(match >= BASE_WINDOW)
    repeated = _cover(five, five + BASE_WINDOW, n)
    long = np.flatnonzero(match >= MIN_REPEAT)
    spanned = _cover(long, long + match[long], n)
    n_repeat = sums(repeated, words.cuts)
    fraction = sums(spanned, words.cuts) / np.maximum(count, 1)
    longest = np.zeros(len(part), np.int64)
    np.maximum.at(longest, words.owner(), match)
    points = np.concatenate([[0], np.cumsum(SPACED[part.data] & ~_CONTINUES[part.data])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[part.data])])
    cut = part.offsets
    failed = (count < MIN_WORDS) | (100 * n_repeat > MAX_BASE_PERCENT * count)
    return {
        "n_words": count, "word_chars": points[cut[1:]] - points[cut[:-1]], "n_symbols": symbols[cut[1:]] - symbols[cut[:-1]], "n_dup_lines": _duplicate_lines(part), "n_repeat_words": n_repeat,
        "covered_fraction": fraction, "longest_repeat": longest, "base_failed": failed, "kept": ~failed & (fraction <= MAX_COVERED) & (longest <= MAX_LONGEST),
    }


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with all features and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = judge(part)
            yield pa.record_batch([part.column("doc_id"), *(pa.array(v) for v in found.values())], names=["doc_id", *found])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FEATURES)


def keep_clean(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            yield part.rows.filter(pa.array(judge(part)["kept"]))
        trim()

    return docs.mapInArrow(run, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("longest_repeat")


#: By windows instead of suffixes: a word is in a repeat of at least L words if it is in a window of L words that stands twice, and the longest repeat has more than L words if a window of L + 1 does.
OP5_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT r, l, k, array_to_string(ws[k : k + l - 1], ' ') AS win FROM (
    SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS k FROM w, (VALUES ({BASE_WINDOW}), ({MIN_REPEAT}), ({MAX_LONGEST + 1})) AS v(l) WHERE len(ws) >= l)
), twice AS (
  SELECT r, l, k FROM (SELECT *, count(*) OVER (PARTITION BY r, l, win) AS n FROM p) WHERE n > 1
), hit AS (
  SELECT r, l, count(DISTINCT q) AS n FROM (SELECT r, l, unnest(range(k, k + l)) AS q FROM twice) GROUP BY r, l
), f AS (
  SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         CAST(coalesce(a.n, 0) AS BIGINT) AS n_repeat_words, coalesce(b.n, 0) / greatest(len(ws), 1) AS covered_fraction, coalesce(c.n, 0) > 0 AS too_long
  FROM w LEFT JOIN hit a ON a.r = w.r AND a.l = {BASE_WINDOW} LEFT JOIN hit b ON b.r = w.r AND b.l = {MIN_REPEAT} LEFT JOIN hit c ON c.r = w.r AND c.l = {MAX_LONGEST + 1}
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, covered_fraction,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_BASE_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_BASE_PERCENT} * n_words) AND covered_fraction <= {MAX_COVERED} AND NOT too_long AS kept
FROM f
"""
