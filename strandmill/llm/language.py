"""Language identification with a bit-sliced Bloom filter of n-grams.

Texts become bytes in which ASCII letters are lower-cased and every other ASCII byte is a blank; n-grams of
`GRAM` bytes that hold no two blanks in a row are taken. Each n-gram has `PROBES` rows in a table of `ROWS` rows, one bit for each
language, in as many words of 64 bits as there are languages (the slices of one Bloom filter for each language, side by side), so the bitwise and of its
rows is the set of all languages that hold it. A language holds an n-gram if it is there often enough, and
not much rarer than in the language where it is most frequent.

The n-grams of a text are told apart by how many languages hold them, h (`MOST_HOLDERS` and more are one class). In each class a language has a popcount, the number of
n-grams in whose set it is, and (popcount - n f) / (1 - f) of it, if that is more than 0, are real, where n is the size of the class and f the filter's rate of
false positives for the language. A real hit counts 1 / h. The language with the most is the prediction; the score is its share of all.

Learning takes every labelled row it is given: counts of n-grams are summed for each task and language, then over
the table in a tree, in `SHARDS` shards (an n-gram is 32 bits, so a shard has at most 2**24 of them whatever the size of the table). Only n-grams with a share of `LEAST_SHARE` or more of a language's are gathered,
and with many languages a larger share, so that `MOST_GRAMS` bounds them all. The broadcast filter has a bit for each row and language, and no more than `MOST_BYTES`: with over
1024 languages it has fewer rows.

Defined results: a null text or one without a letter is `und` with score 0; any number of languages is learned;
where no language has a hit the text gets the language with most n-grams learned, with score 0; ties go to the first language in order; repeated rows are predicted alike; rows with null
languages teach nothing; with nothing learned all are `und`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.packing import cut_up, pack, summed, tree_rounds, tree_sum, unpack, unpack_all
from strandmill.llm.shared import Tables, partitions_of
from strandmill.llm.textarrays import Slice, mix, slices

GRAM = 4
ROW_BITS = 22
ROWS = 1 << ROW_BITS
PROBES = 2
SHARDS = 256
MOST_GRAMS = 1 << 25
MOST_BYTES = 512 << 20
MOST_HOLDERS = 8
LEAST_SHARE = 2e-6
LEAST_COUNT = 2
RELATIVE = 0.1

_CLEAN = np.where(np.arange(256) < 128, 32, np.arange(256)).astype(np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)


def grams_of(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text (never across texts), and the cuts between texts."""
    data = _CLEAN[part.data].astype(np.uint64)
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(part) + 1, np.int64)
    whole = data[:n].copy()
    for k in range(1, GRAM):
        whole |= data[k : n + k] << np.uint64(8 * k)
    blank = data == 32
    good = np.ones(n, bool)
    for k in range(GRAM - 1):
        good &= ~(blank[k : n + k] & blank[k + 1 : n + k + 1])
    good &= np.repeat(part.offsets[1:], np.diff(part.offsets))[:n] >= np.arange(n) + GRAM
    at = np.flatnonzero(good)
    return mix(whole[at]), np.searchsorted(at, part.offsets)


def rows_of(hashes: np.ndarray, bits: int = ROW_BITS) -> list[np.ndarray]:
    """The rows of each n-gram, one for each probe."""
    return [((hashes >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(PROBES)]


def has_letter(part: Slice) -> np.ndarray:
    ascii_letter = np.concatenate([[0], np.cumsum((part.data | 32) - 97 < 26)])
    out = ascii_letter[part.offsets[1:]] > ascii_letter[part.offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(part.offsets) > 0)):
        out[i] = any(c.isalpha() for c in part.text(i).decode())
    return out & part.valid


class Languages:
    """The filter: names, table of bit sets, and the rate of false positives of each language."""

    def __init__(self, grams: dict[str, np.ndarray], sizes: dict[str, int]):
        """grams: the n-grams that each language holds; sizes: how many each was learned from."""
        self.names = sorted(grams)
        self.common = max(self.names, key=lambda x: sizes.get(x, 0), default="und")
        words = max(1, -(-len(self.names) // 64))
        self.kind = np.uint8 if len(self.names) <= 8 else np.uint64
        self.bits = ROW_BITS
        while (words * np.dtype(self.kind).itemsize << self.bits) > MOST_BYTES:
            self.bits -= 1
        self.table = np.zeros((words, 1 << self.bits), self.kind)
        false = []
        for i, name in enumerate(self.names):
            for rows in rows_of(grams[name], self.bits):
                self.table[i // 64][rows] |= self.kind(1 << i % 64)
        for i in range(len(self.names)):
            false.append(float(((self.table[i // 64] >> self.kind(i % 64)) & self.kind(1)).mean()) ** PROBES)
        self.false = np.minimum(np.array(false), 0.999)

    def holders(self, hashes: np.ndarray) -> np.ndarray:
        """The set of languages of each n-gram, in words."""
        first, *others = rows_of(hashes, self.bits)
        out = self.table[:, first]
        for rows in others:
            out &= self.table[:, rows]
        return out

    def shares(self, sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """(language, text): corrected hits, class by class."""
        texts = len(cuts) - 1
        held = np.minimum(sum(np.bitwise_count(w).astype(np.int64) for w in sets), MOST_HOLDERS)
        group = np.repeat(np.arange(texts), np.diff(cuts)) * (MOST_HOLDERS + 1) + held
        cells = texts * (MOST_HOLDERS + 1)
        size = np.bincount(group, minlength=cells)
        weight = 1.0 / np.maximum(np.arange(MOST_HOLDERS + 1), 1)
        out = []
        for i, f in enumerate(self.false):
            hits = np.bincount(group[(sets[i // 64] & self.kind(1 << i % 64)) != 0], minlength=cells)
            real = np.maximum(hits - size * f, 0) / (1 - f)
            out.append(np.minimum(real, hits).reshape(texts, -1) @ weight)
        return np.array(out)

    def predict(self, part: Slice) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(part), np.zeros(len(part))
        if not self.names:
            return names, scores
        hashes, cuts = grams_of(part)
        both = self.shares(self.holders(hashes), cuts)
        best, total = both.argmax(axis=0), both.sum(axis=0)
        letters = has_letter(part)
        for i in np.flatnonzero(letters & ~(total > 1e-12)):
            names[i] = self.common
        for i in np.flatnonzero(letters & (total > 1e-12)):
            names[i] = self.names[best[i]]
            scores[i] = both[best[i], i] / total[i]
        return names, np.clip(scores, 0, 1)


def learn(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Counts every n-gram of every labelled text and keeps those that mark a language."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in slices(batches):
            hashes, cuts = grams_of(part)
            names, codes = np.unique(np.array(part.column("lang").to_pylist(), dtype=str), return_inverse=True)
            of = np.repeat(codes, np.diff(cuts))
            for k, name in enumerate(names):
                own = hashes[of == k].view(np.int64)
                before = known.get(name, (np.empty(0, np.int64), np.empty(0, np.int64)))
                known[name] = summed(np.concatenate([before[0], own]), np.concatenate([before[1], np.ones(len(own), np.int64)]))
        task = TaskContext.get()
        here = task.partitionId() if task else 0
        for name, (grams, n) in known.items():
            shard = (grams.view(np.uint64) >> np.uint64(56)).astype(np.int64)
            order, parts = cut_up(shard)
            for k, a, b in parts:
                yield pa.record_batch([pa.array([str(name)]), pa.array([k], pa.int32()), pa.array([here], pa.int64()), pa.array([pack([grams[order[a:b]], n[order[a:b]]])], pa.binary())], names=["lang", "shard", "part", "blob"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(unpack(b)[0][1].sum()) for b in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=["lang", "n"])

    spark = labelled.sparkSession
    tables = Tables(spark, "language")
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    counts = tree_sum(rows.mapInArrow(count, "lang string, shard int, part long, blob binary"), {"lang": pa.string(), "shard": pa.int32()}, tree_rounds(max(partitions_of(spark), size >> 27)))
    counted = tables.put("counts", counts)
    total = {r["lang"]: r["n"] for r in counted.mapInArrow(sizes, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = max(LEAST_SHARE, len(total) / MOST_GRAMS)

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        own = {lang: unpack(blob)[0] for lang, blob in zip(table.column("lang").to_pylist(), table.column("blob").to_pylist(), strict=True)}
        keys = np.unique(np.concatenate([g for g, _ in own.values()]))
        most = np.zeros(len(keys))
        for lang, (grams, n) in own.items():
            at = np.searchsorted(keys, grams)
            most[at] = np.maximum(most[at], np.where(n >= LEAST_COUNT, n / total[lang], 0))
        kept = []
        for lang, (grams, n) in own.items():
            share = np.where(n >= LEAST_COUNT, n / total[lang], 0)
            kept.append((lang, grams[(share >= least) & (share >= RELATIVE * most[np.searchsorted(keys, grams)])]))
        return pa.table([pa.array([x for x, _ in kept]), pa.array([pack([g]) for _, g in kept], pa.binary())], names=["lang", "blob"])

    grams: dict[str, list[bytes]] = {}
    for r in counted.groupBy("shard").applyInArrow(choose, "lang string, blob binary").collect():
        grams.setdefault(r["lang"], []).append(r["blob"])
    tables.free(counted)
    return Languages({lang: unpack_all(blobs, 1)[0].view(np.uint64) for lang, blobs in grams.items()}, total)


def identify(docs: DataFrame, known: Languages, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    model = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names, scores = model.value.predict(part)
            yield pa.record_batch([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = learn(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))))
    return identify(docs, known).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
