"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. An item of the
benchmark gives all its windows of `n` words; one of fewer words, but not none, gives one window
of all of them. The scan hashes every window of every document, looks it up first in a
bitmap and then in the sorted hashes, and compares the words themselves before it counts a hit.

The set is broadcast in blocks of at most `block_bytes` of benchmark text. One block is one pass without a
shuffle. More of them are built, broadcast and freed one after the other, and each writes what it found
in the texts it hit; that depends on the text alone, so it is merged by the text's SHA-256 and joined with
the rows. Spans are those of the input whatever the number of blocks, so the result is the same at every size.

Defined results: a null or empty text has no words and no hit; a null or empty item has no
window; repeated items or rows count once per item id and once per row; an item with a null id
still marks words but is not listed; empty tables give no rows or no hits. Only the id and
text columns are read for reports, so other columns may have any name; `clean` returns the input's
columns. An item is in one block, so its text has to fit there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.llm.shared import Tables
from strandmill.llm.textarrays import ALNUM, LOWER, Slice, Words, covered, runs, slices, text_arrays, windows_of, words_of

WINDOW = 10
BLOCK_BYTES = 16 << 20
BITMAP_BITS = 1 << 22

REPORT = "doc_id long, n_words long, n_hit long, span_start array<long>, span_end array<long>, items array<string>"
FOUND = "key string, span_start array<long>, span_end array<long>, items array<string>"


def window_text(data: np.ndarray, words: Words, start: int, length: int) -> bytes:
    return b" ".join(data[words.start[j] : words.end[j]].tobytes() for j in range(start, start + length))


class Level:
    """The distinct windows of one length: sorted hashes, one place of each in the benchmark, and the items that have it."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, owner: np.ndarray):
        order = np.lexsort((owner, hashes))
        hashes, starts, owner = hashes[order], starts[order], owner[order]
        self.bitmap = np.zeros(BITMAP_BITS, bool)
        self.bitmap[(hashes & np.uint64(BITMAP_BITS - 1)).astype(np.int64)] = True
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        self.keys, self.cuts = hashes[fresh], np.append(np.flatnonzero(fresh), len(hashes))
        self.starts, self.owner = starts.astype(np.int32), owner.astype(np.int32)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the number of each one's key."""
        maybe = np.flatnonzero(self.bitmap[(hashes & np.uint64(BITMAP_BITS - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        same = self.keys[at] == hashes[maybe]
        return maybe[same], at[same]


class WindowSet:
    """Windows of a block of the benchmark by their length in words, as sorted arrays; texts are kept once, as bytes."""

    def __init__(self, rows: list[tuple[str | None, str | None]], n: int = WINDOW):
        offsets, data, _ = text_arrays(pa.array([r[1] for r in rows], pa.string()))
        self.n, self.data = n, LOWER[data]
        self.words = words_of(self.data, offsets, ALNUM)
        hashes, starts = windows_of(self.words, n, short_whole=True)
        self.words.hashes = None
        self.names = sorted({r[0] for r in rows if r[0] is not None})
        number = {name: k for k, name in enumerate(self.names)}
        of_row = np.array([number.get(r[0], -1) for r in rows], np.int64)
        row = np.searchsorted(self.words.cuts, starts, "right") - 1
        length = np.minimum(n, self.words.cuts[row + 1] - starts)
        self.levels = {int(k): Level(hashes[length == k], starts[length == k], of_row[row[length == k]]) for k in np.unique(length)}
        self.texts: dict[tuple[int, int], dict[bytes, np.ndarray]] = {}

    def items_of(self, length: int, key: int) -> dict[bytes, np.ndarray]:
        """The texts that have the hash of a key, mostly one, and the items of each. Kept once it was asked for."""
        found = self.texts.get((length, key))
        if found is None:
            level = self.levels[length]
            by: dict[bytes, set[int]] = {}
            for k in range(level.cuts[key], level.cuts[key + 1]):
                by.setdefault(window_text(self.data, self.words, int(level.starts[k]), length), set()).add(int(level.owner[k]))
            found = self.texts[length, key] = {text: np.array(sorted(x - {-1}), np.int64) for text, x in by.items()}
        return found

    def __getstate__(self) -> dict:
        return self.__dict__ | {"texts": {}}


def hits(part: Slice, known: WindowSet) -> tuple[Words, np.ndarray, list[list[str]]]:
    """Words, a flag for each hit word, and the items found in each text, in order."""
    data = LOWER[part.data]
    words = words_of(data, part.offsets, ALNUM)
    items: list[set[int]] = [set() for _ in range(len(part))]
    starts_hit: list[int] = []
    ends_hit: list[int] = []
    for length, level in known.levels.items():
        hashes, starts = windows_of(words, length, short_whole=False)
        maybe, keys = level.places(hashes)
        owner = np.searchsorted(words.cuts, starts[maybe], "right") - 1
        for key, s, i in zip(keys.tolist(), starts[maybe].tolist(), owner.tolist(), strict=True):
            ids = known.items_of(length, key).get(window_text(data, words, s, length))
            if ids is not None:
                starts_hit.append(s)
                ends_hit.append(s + length)
                items[i].update(ids.tolist())
    flags = covered(np.array(starts_hit, np.int64), np.array(ends_hit, np.int64), len(words.start))
    return words, flags, [[known.names[k] for k in sorted(x)] for x in items]


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _spans(words: Words, flags: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    total = np.concatenate([[0], np.cumsum(flags)])
    some = total[words.cuts[1:]] > total[words.cuts[:-1]]
    return [runs(flags[low:high]) if hit else ((), ()) for low, high, hit in zip(words.cuts, words.cuts[1:], some, strict=False)]


class Blocks:
    """The benchmark's distinct rows in blocks, of which one is in memory at a time."""

    def __init__(self, benchmark: DataFrame, n: int, block_bytes: int, item_col: str, text_col: str):
        self.n, self.rows = n, benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
        size = self.rows.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
        self.count = max(1, -(-size // block_bytes))

    def one(self, spark: SparkSession, k: int) -> Broadcast:
        rows = self.rows if self.count == 1 else self.rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.count)) == k)
        return spark.sparkContext.broadcast(WindowSet([tuple(r) for r in rows.collect()], self.n))

    def found(self, spark: SparkSession, texts: DataFrame) -> DataFrame:
        """(key, span_start, span_end, items) of the texts that any block hit. texts: text; key is the text's SHA-256."""
        tables = Tables(spark, "decontaminate")
        keyed, parts = texts.select("text", F.sha2("text", 256).alias("key")), []
        for k in range(self.count):
            block = self.one(spark, k)

            def run(batches: Iterator[pa.RecordBatch], known: Broadcast = block) -> Iterator[pa.RecordBatch]:
                for part in slices(batches):
                    words, flags, items = hits(part, known.value)
                    spans = _spans(words, flags)
                    some = [i for i, (a, _) in enumerate(spans) if len(a)]
                    if some:
                        yield pa.record_batch([part.column("key").take(pa.array(some)), _lists([spans[i][0] for i in some], pa.int64()), _lists([spans[i][1] for i in some], pa.int64()), _lists([items[i] for i in some], pa.string())], names=["key", "span_start", "span_end", "items"])

            parts.append(tables.put("found", keyed.mapInArrow(run, FOUND).distinct()))
            block.destroy()
        if len(parts) == 1:  # one row for each text, its spans apart
            return parts[0]
        both = parts[0]
        for x in parts[1:]:
            both = both.unionByName(x)
        # At most one row a block and text comes together. A span is a new one if it starts behind all before it.
        items = both.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        spans = both.select("key", F.explode(F.arrays_zip(F.col("span_start").alias("a"), F.col("span_end").alias("b"))).alias("x")).select("key", "x.a", "x.b")
        before = Window.partitionBy("key").orderBy("a", "b")
        spans = spans.withColumn("last", F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1)))
        spans = spans.withColumn("n", F.count_if(F.col("last").isNull() | (F.col("a") > F.col("last"))).over(before.rowsBetween(Window.unboundedPreceding, 0)))
        spans = spans.groupBy("key", "n").agg(F.min("a").alias("a"), F.max("b").alias("b")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s"))
        merged = spans.join(items, "key")
        return merged.select("key", F.transform("s", lambda x: x["a"]).alias("span_start"), F.transform("s", lambda x: x["b"]).alias("span_end"), "items")


def report(docs: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document: its words, hit words, spans of hit words and items found."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = Blocks(benchmark, n, block_bytes, item_col, item_text_col)
    known = blocks.one(spark, 0) if blocks.count == 1 else spark.sparkContext.broadcast(WindowSet([], n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, flags, items = hits(part, known.value)
            total, spans = np.concatenate([[0], np.cumsum(flags)]), _spans(words, flags)
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(np.diff(words.cuts), pa.int64()), pa.array(total[words.cuts[1:]] - total[words.cuts[:-1]], pa.int64()), _lists([a for a, _ in spans], pa.int64()), _lists([b for _, b in spans], pa.int64()), _lists(items, pa.string()), *part.rows.columns[2:]],
                names=[*REPORT_NAMES, *part.rows.schema.names[2:]],
            )

    if blocks.count == 1:
        return source.mapInArrow(scan, REPORT)
    found = blocks.found(spark, source.select("text"))
    rows = source.withColumn("key", F.sha2("text", 256)).mapInArrow(scan, REPORT + ", key string").select("doc_id", "n_words", "key")
    none = F.array().cast("array<long>")
    length = F.aggregate(F.zip_with("span_start", "span_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    out = rows.join(found, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce(length, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("span_start", none).alias("span_start"), F.coalesce("span_end", none).alias("span_end"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


REPORT_NAMES = ["doc_id", "n_words", "n_hit", "span_start", "span_end", "items"]


def without_spans(part: Slice, words: Words, spans: list) -> list[str | None]:
    """The texts without the bytes of their spans of words."""
    texts = [part.text(i).decode() if v else None for i, v in enumerate(part.valid)]
    for i, (starts, ends) in enumerate(spans):
        if len(starts):
            raw, base, low = part.text(i), part.offsets[i], words.cuts[i]
            kept, at = [], 0
            for s, e in zip(starts, ends, strict=True):
                kept.append(raw[at : words.start[low + s] - base])
                at = words.end[low + e - 1] - base
            texts[i] = b"".join([*kept, raw[at:]]).decode()
    return texts


def clean(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", n: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The input's rows without contaminated documents, or with the hit spans cut out of their texts (remove="spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # columns go by place, so their names can't clash with ours
    text, names = f"c{place}", plain.columns
    blocks = Blocks(benchmark, n, block_bytes, item_col, item_text_col)
    known = blocks.one(spark, 0) if blocks.count == 1 else None
    if known is None:
        found = blocks.found(spark, plain.select(F.col(text).alias("text")))
        keyed = plain.withColumn("key", F.sha2(text, 256))
        if remove == "documents":
            return keyed.join(found, "key", "left_anti").select(*plain.columns).toDF(*docs.columns)
        rows = keyed.join(found, "key", "left").select(*plain.columns, "span_start", "span_end")
    else:
        rows = plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            if known is None:
                words = words_of(LOWER[part.data], part.offsets, ALNUM, hashed=False)
                spans = [(a or (), b or ()) for a, b in zip(part.column("span_start").to_pylist(), part.column("span_end").to_pylist(), strict=True)]
            else:
                words, flags, _ = hits(part, known.value)
                spans = _spans(words, flags)
            out = part.rows.select(names)
            hit = np.array([len(a) > 0 for a, _ in spans], bool)
            if remove == "documents":
                out = out.filter(pa.array(~hit))
            elif hit.any():
                out = out.set_column(place, out.schema.field(place), pa.array(without_spans(part, words, spans), out.schema.field(place).type))
            yield out

    return rows.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = report(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), bi AS (
  SELECT item_id, ws, least(len(ws), 10) AS l, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, l, array_to_string(ws[p : p + l - 1], ' ') AS win FROM bi
), lengths AS (
  SELECT DISTINCT l FROM bw
), di AS (
  SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM w, lengths WHERE len(ws) >= l
), dw AS (
  SELECT doc_id, l, p, array_to_string(ws[p : p + l - 1], ' ') AS win FROM di
), hit AS (
  SELECT dw.doc_id, dw.l, dw.p, bw.item_id FROM dw JOIN bw USING (l, win)
), hw AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
