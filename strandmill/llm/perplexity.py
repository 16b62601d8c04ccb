"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and language-specific quantiles.

The model is over bytes, of order `ORDER` = 5. Training counts all 5-grams of all trusted texts. Counts are
sharded by the two middle bytes c3 c4 of (c1 c2 c3 c4 c5): every n-gram of order 3 and more that a probability needs, and
its context, have these two bytes in one place, so a shard holds all the counts of its n-grams,
the continuation counts of the lower orders included. The parts of many tasks are summed in a tree, so a frequent pair is no
more than a few parts in a task. Only orders 2 and 1 (65 536 numbers and 256, a fixed size) and the
counts of counts are gathered for all.

Scoring: texts are packed into slices; each asks every shard for its distinct 5-grams, the shards join these
with their counts and answer with log probabilities, and the answers meet their slice again, where each
document's perplexity is computed. A shard of which a sample of the slices shows more than `SALT_CODES` requests is split by slice over as many tasks as it needs,
and only such a shard is copied, once for each `SALT_CODES` requests, so the copies are a share of the requests; the sample decides the routing only. What is gathered from the corpus grows with the trusted text; nothing is capped.

Trusted texts are dealt into `FOLDS` by the hash of their id. Fold 0 is held out: it does not train the model, and the limits are
quantiles over it, so they are those of unseen clean text. A document is kept if its perplexity, and its peak, the highest
mean cost of `PEAK` successive 5-grams, are each at most the `QUANTILE` quantile of the held-out documents of its
language (of all held-out documents, where a language has fewer than `FEWEST`). A few odd words do not move the mean; they show in the peak.

Defined results: a null text and one of fewer than 5 bytes have no perplexity; they and texts of fewer than `FEWEST_GRAMS` 5-grams are kept
(there is too little against them); without trusted ids to train on or to hold out there is no limit and all are kept; rows with a null id are scored and
are never trusted; repeated rows get equal results; ids repeated in the labels count once; an empty table gives no rows. Only the
columns named are read.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.llm.packing import cut_up, pack, summed, tree_rounds, tree_sum, unpack
from strandmill.llm.shared import Tables, partitions_of
from strandmill.llm.textarrays import Slice, mix, slices, trim

ORDER = 5
#: Bins of a unit of the logarithm for exact quantiles, and finer bins of each.
_BINS, _FINER = 64, 4096
QUANTILE = 0.99
FOLDS = 2  # fold 0 of the trusted texts sets the limits, the others train
PEAK = 6  # 5-grams of a window: ten bytes, about a word and its edges
FEWEST = 20
FEWEST_GRAMS = 10
SLICE = 3600 << 10  # four blocks of bz2, which packs text best: the packed texts are most of the disk used
SHARD_BYTES = 16 << 20
SALT_CODES = 1 << 26  # requests of a task: about as many bytes, packed
SAMPLE_ONE_IN = 64
FILTER_BITS = 23
SCALE = 1024.0  # answers are whole numbers of 1/1024 nat
_MIDDLE = np.uint64(8)


def codes_of(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """5-grams as numbers of 40 bits, never across texts, and the cuts between texts."""
    data = part.data.astype(np.int64)
    n = len(data) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.int64), np.zeros(len(part) + 1, np.int64)
    code = data[:n].copy()
    for k in range(1, ORDER):
        code <<= 8
        code |= data[k : n + k]
    size = np.maximum(np.diff(part.offsets) - ORDER + 1, 0)
    cuts = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(cuts[-1]) + np.repeat(part.offsets[:-1] - cuts[:-1], size)
    return code[at], cuts


def shards_of(size: int) -> int:
    """Shards for so many bytes of text. Their number is not bounded, but only 65 536 pairs of bytes can fill them."""
    return max(1, -(-size // SHARD_BYTES))


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return (mix(((codes >> 8) & 0xFFFF).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


class Level:
    """Counts of one order: n-grams, their counts, and for each context its sum and how many have 1, 2, and 3 or more."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        context = grams >> 8
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(grams) else np.empty(0, np.int64)
        self.contexts = context[at]
        add = lambda x: np.add.reduceat(x, at) if len(at) else np.empty(0, np.int64)
        self.total = add(counts)
        self.few = [add((counts == 1).astype(np.int64)), add((counts == 2).astype(np.int64)), add((counts >= 3).astype(np.int64))]

    def lower(self, bits: int) -> Level:
        """Continuation counts of the n-grams one shorter: in how many distinct n-grams each is the end."""
        return Level(*summed(self.grams & ((1 << bits) - 1), np.ones(len(self.grams), np.int64)))

    def counts_of_counts(self) -> list[int]:
        return [int((self.counts == k).sum()) for k in (1, 2, 3, 4)]

    def probability(self, grams: np.ndarray, below: np.ndarray, discount: np.ndarray) -> np.ndarray:
        """Interpolated: discounted counts and the share kept for the lower order."""
        if not len(self.grams):
            return below
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        count = np.where(self.grams[at] == grams, self.counts[at], 0)
        context = grams >> 8
        of = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = self.contexts[of] == context
        total = np.where(known, self.total[of], 1)
        spared = sum(discount[k] * few[of] for k, few in enumerate(self.few))
        first = np.maximum(count - discount[np.clip(count, 1, 3) - 1], 0) * (count > 0)
        return np.where(known, (first + spared * below) / total, below)


def discounts(n: list[int]) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from how many n-grams have 1, 2, 3 and 4 counts."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return np.array([min(max(d, 0.05), top) for d, top in zip(found, (0.95, 1.9, 2.85), strict=True)])


class Small:
    """The two lowest orders and the discounts of all."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, of_counts: dict[int, list[int]]):
        two = Level(*summed(pairs, counts))
        one = two.lower(8)
        self.discount = {k: discounts(of_counts.get(k, [0, 0, 0, 0])) for k in (3, 4, 5)}
        total = max(1, int(one.counts.sum()))
        d1, d2 = discounts(one.counts_of_counts()), discounts(two.counts_of_counts())
        share = np.zeros(256)
        share[one.grams] = np.maximum(one.counts - d1[np.clip(one.counts, 1, 3) - 1], 0) / total
        share += (1 - share.sum()) / 256
        every = np.arange(1 << 16)
        self.pairs = two.probability(every, share[every & 0xFF], d2)


class Shard:
    """All counts of the n-grams of a shard."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.five = Level(grams, counts)
        self.four = self.five.lower(32)
        self.three = self.four.lower(24)

    def log_probability(self, codes: np.ndarray, small: Small) -> np.ndarray:
        p = small.pairs[codes & 0xFFFF]
        for level, bits, k in ((self.three, 24, 3), (self.four, 32, 4), (self.five, 40, 5)):
            p = level.probability(codes & ((1 << bits) - 1), p, small.discount[k])
        return np.log(np.maximum(p, 1e-12))


def _bits_of(ids: np.ndarray) -> list[np.ndarray]:
    """Places of an id in a filter of 2**FILTER_BITS bits."""
    mixed = mix(ids.view(np.uint64))
    return [(mixed >> np.uint64(20 * k) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for k in range(3)]


def likely(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows whose id may be among the ids: a Bloom filter of a fixed size, so the join after it shuffles few other texts."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for places in _bits_of(np.asarray(batch.column(0))):
                bits[places] = True
        for k, part in enumerate(np.packbits(bits).reshape(16, -1)):
            if part.any():
                yield pa.record_batch([pa.array([k]), pa.array([part.tobytes()], pa.binary())], names=["part", "bits"])

    def either(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
        return pa.table([pa.array([key[0].as_py()]), pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())], names=["part", "bits"])

    schema = "part long, bits binary"
    whole = np.zeros((16, 1 << FILTER_BITS >> 7), np.uint8)
    for r in ids.mapInArrow(mark, schema).groupBy("part").applyInArrow(either, schema).collect():
        whole[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(np.unpackbits(whole.reshape(-1)).astype(bool))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            there = np.asarray(column.is_valid())
            for places in _bits_of(np.asarray(column.fill_null(0))):
                there = there & known.value[places]
            yield batch.filter(pa.array(there))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(keep, "doc_id long, text string")


def _packed(rows: DataFrame) -> DataFrame:
    """(slice, blob): the rows of each slice, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        place = (task.partitionId() if task else 0) << 32
        for k, part in enumerate(slices(batches, max_bytes=SLICE)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.rows.schema) as out:
                out.write_batch(part.rows)
            yield pa.record_batch([pa.array([place + k]), pa.array([bz2.compress(sink.getvalue())], pa.binary())], names=["slice", "blob"])
        trim()

    return rows.mapInArrow(run, "slice long, blob binary")


def _open(blob: bytes) -> Slice:
    batch = pa.ipc.open_stream(bz2.decompress(blob)).read_all().combine_chunks().to_batches()[0]
    (part,) = slices([batch], max_bytes=1 << 40)
    return part


def _count(trusted: DataFrame, shards: int, tasks: int) -> DataFrame:
    """(shard, blob): 5-grams and counts of the trusted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part_of = task.partitionId() if task else 0

        def out(grams: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            order, parts = cut_up(shard_of(grams, shards))
            for k, a, b in parts:
                yield pa.record_batch([pa.array([k]), pa.array([part_of]), pa.array([pack([grams[order[a:b]], n[order[a:b]]])], pa.binary())], names=["shard", "part", "blob"])

        grams, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in slices(batches):
            codes, _ = codes_of(part)
            own, times = summed(codes, np.ones(len(codes), np.int64))
            grams, n = summed(np.concatenate([grams, own]), np.concatenate([n, times]))
            if len(grams) > 4_000_000:
                yield from out(grams, n)
                grams, n = grams[:0], n[:0]
        yield from out(grams, n)
        trim()

    return tree_sum(trusted.select("text").mapInArrow(run, "shard long, part long, blob binary"), {"shard": pa.int64()}, tree_rounds(tasks))


def _salts(packed: DataFrame, shards: int) -> dict[int, int]:
    """Into how many parts the requests of a shard are split, for the shards of more than one.

    At most one shard for each `SALT_CODES` requests is there, and no more than the 65 536 pairs of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                _, parts = cut_up(shard_of(np.unique(codes_of(_open(blob))[0]), shards))
                yield pa.record_batch([pa.array([k for k, _, _ in parts], pa.int64()), pa.array([b - a for _, a, b in parts], pa.int64())], names=["shard", "n"])
        trim()

    sample = packed.where(F.pmod(F.xxhash64("slice"), F.lit(SAMPLE_ONE_IN)) == 0).mapInArrow(run, "shard long, n long")
    hot = sample.groupBy("shard").agg((F.sum("n") * SAMPLE_ONE_IN).alias("n")).where(F.col("n") > SALT_CODES).collect()
    return {r["shard"]: -(-r["n"] // SALT_CODES) for r in hot}


def _small(counts: DataFrame) -> Small:
    """Counts of counts and the pairs' continuation counts: numbers of a fixed size from each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                shard = Shard(*unpack(blob)[0])
                pairs, n = summed(shard.three.grams & 0xFFFF, np.ones(len(shard.three.grams), np.int64))
                of = [np.array(x.counts_of_counts()) for x in (shard.three, shard.four, shard.five)]
                keys = np.concatenate([pairs, [-100 * k - j for k in (3, 4, 5) for j in (1, 2, 3, 4)]]).astype(np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(np.concatenate([n, *of]))], names=["key", "n"])

    found = counts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    keys, n = np.array([r["key"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64)
    by = {int(k): int(v) for k, v in zip(keys, n, strict=True) if k < 0}
    of = {k: [by.get(-100 * k - j, 0) for j in (1, 2, 3, 4)] for k in (3, 4, 5)}
    return Small(keys[keys >= 0], n[keys >= 0], of)


def peaks(run: np.ndarray, cuts: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The highest mean of `PEAK` successive costs in each text, from their running sum; a shorter text has its mean."""
    found = mean.copy()
    whole = np.flatnonzero(np.diff(cuts) >= PEAK)
    if len(whole):
        sums = np.append(run[PEAK:] - run[:-PEAK], 0)  # one more, as the last text's end is a place of its own
        ends = np.stack([cuts[whole], cuts[whole + 1] - PEAK + 1], axis=1).reshape(-1)
        found[whole] = np.maximum.reduceat(sums, ends)[::2] / PEAK / SCALE
    return found


def perplexities(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_grams, perplexity and peak (nats a byte) of each row. trusted: rows whose `text` trains the model."""
    spark = docs.sparkSession
    tables = Tables(spark, "perplexity")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()["b"] or 0
    shards = shards_of(total)
    counts = tables.put("counts", _count(trusted.select("text"), shards, max(partitions_of(spark), total >> 27)))
    small = spark.sparkContext.broadcast(_small(counts))
    packed = tables.put("packed", _packed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))))

    salts = _salts(packed, shards)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.unique(codes_of(_open(blob))[0])
                order, parts = cut_up(shard_of(codes, shards))
                salt = int(mix(np.array([name], np.uint64))[0] >> np.uint64(1))
                for k, a, b in parts:
                    yield pa.record_batch([pa.array([k]), pa.array([salt % salts.get(k, 1)]), pa.array([name], pa.int64()), pa.array([pack([codes[order[a:b]]])], pa.binary())], names=["shard", "salt", "slice", "blob"])
        trim()

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        names, blobs = table.column("slice").to_pylist(), table.column("blob").to_pylist()
        held = [b for s, b in zip(names, blobs, strict=True) if s is None]
        shard = Shard(*(unpack(held[0])[0] if held else (np.empty(0, np.int64), np.empty(0, np.int64))))
        out = []
        for s, b in zip(names, blobs, strict=True):
            if s is not None:
                p = shard.log_probability(unpack(b)[0][0], small.value)
                out.append((s, np.rint(p * -SCALE).astype(np.uint16).tobytes()))
        return pa.table([pa.array([s for s, _ in out], pa.int64()), pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["slice", "shard", "blob"])

    asked = packed.mapInArrow(ask, "shard long, salt long, slice long, blob binary")

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for salt in range(salts.get(k, 1)):
                    yield pa.record_batch([pa.array([k]), pa.array([salt]), pa.array([None], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "salt", "slice", "blob"])

    held = counts.mapInArrow(copies, "shard long, salt long, slice long, blob binary")
    answers = tables.put("answers", asked.unionByName(held).groupBy("shard", "salt").applyInArrow(answer, "slice long, shard long, blob binary"))

    def score(texts: pa.Table, replies: pa.Table) -> pa.Table:
        by = dict(zip(replies.column("shard").to_pylist(), replies.column("blob").to_pylist(), strict=True))
        out = []
        for blob in texts.column("blob").to_pylist():
            part = _open(blob)
            codes, cuts = codes_of(part)
            keys, inverse = np.unique(codes, return_inverse=True)
            order, parts = cut_up(shard_of(keys, shards))
            cost = np.zeros(len(keys), np.int64)
            for k, a, b in parts:
                cost[order[a:b]] = np.frombuffer(by[k], np.uint16)
            run = np.concatenate([[0], np.cumsum(cost[inverse])])
            n = np.diff(cuts)
            mean = (run[cuts[1:]] - run[cuts[:-1]]) / np.maximum(n, 1) / SCALE
            out.append(pa.table([part.column("doc_id"), part.column("lang"), pa.array(n), pa.array(np.exp(mean), mask=n == 0), pa.array(peaks(run, cuts, mean), mask=n == 0)], names=["doc_id", "lang", "n_grams", "perplexity", "peak"]))
        trim()
        return pa.concat_tables(out)

    schema = "doc_id long, lang string, n_grams long, perplexity double, peak double"
    return packed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, schema)


def exact_quantile(values: DataFrame, quantile: float) -> DataFrame:
    """l, limit, n: of each l the least value that so large a part of its values does not exceed, at any size. values: l, v (above 0).

    Values are counted in bins of their logarithm, then the bin that holds the rank in finer ones, and only the values of the last bin are ranked themselves."""
    at = values.withColumn("_log", F.log("v") * _BINS)
    picked: DataFrame | None = None
    for bin_ in (F.floor("_log"), F.floor((F.col("_log") - F.floor("_log")) * _FINER), F.col("v")):
        keyed = at.withColumn("_bin", bin_)
        if picked is not None:
            keyed = keyed.join(picked, "l")
        keep = ["l"] + (["rank"] if picked is not None else [])
        counts = keyed.groupBy(*keep, "_bin").agg(F.count("*").alias("c"))
        whole, so_far = Window.partitionBy("l"), Window.partitionBy("l").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumns({"n": F.sum("c").over(whole), "upto": F.sum("c").over(so_far)})
        rank = F.col("rank") if picked is not None else F.greatest(F.ceil(F.lit(quantile) * F.col("n")), F.lit(1))
        found = counts.withColumn("rank", rank).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        sizes = found.select("l", "n") if picked is None else sizes
        picked = found.select("l", "_bin", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
        at = keyed.drop("rank").join(picked.drop("rank"), ["l", "_bin"]).drop("_bin")
        last, picked = picked, picked.drop("_bin")
    return last.select("l", F.col("_bin").alias("limit")).join(sizes, "l")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_grams, perplexity, peak, limit, peak_limit and kept. labels: doc_id, quality, toxic; trusted are those of quality 1 that aren't toxic."""
    ids = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_trusted")).distinct()
    fold = F.pmod(F.xxhash64("_trusted"), F.lit(FOLDS))
    train, held = ids.where(fold != 0), ids.where(fold == 0)
    if train.isEmpty() or held.isEmpty():
        none = F.lit(None).cast("double")
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.lit(0).cast("long").alias("n_grams"), none.alias("perplexity"), none.alias("peak"), none.alias("limit"), none.alias("peak_limit"), F.lit(True).alias("kept"))
    # The same join at every size: neither side's size is bounded.
    trusted = likely(docs, train, id_col, text_col).join(train.hint("merge"), F.col("doc_id") == F.col("_trusted"), "left_semi")
    tables = Tables(docs.sparkSession, "classify")
    scored = tables.put("scored", perplexities(docs, trusted, id_col=id_col, text_col=text_col, lang_col=lang_col))
    known = tables.put("known", scored.join(held, F.col("doc_id") == F.col("_trusted"), "left_semi").where("perplexity IS NOT NULL").select(F.col("lang").alias("l"), "perplexity", "peak"))
    limit, peak = (exact_quantile(known.where("l IS NOT NULL").select("l", F.col(c).alias("v")), quantile) for c in ("perplexity", "peak"))
    by_lang = tables.put("limits", limit.where(F.col("n") >= FEWEST).select("l", F.col("limit").alias("own")).join(peak.select("l", F.col("limit").alias("own_peak")), "l"))
    overall = {name: (exact_quantile(known.select(F.lit("").alias("l"), F.col(c).alias("v")), quantile).first() or {"limit": None})["limit"] for name, c in (("all", "perplexity"), ("all_peak", "peak"))}
    out = scored.join(by_lang, F.col("lang") == F.col("l"), "left")
    limits, tops = F.coalesce("own", F.lit(overall["all"]).cast("double")), F.coalesce("own_peak", F.lit(overall["all_peak"]).cast("double"))
    within = (F.col("perplexity") <= limits) & (F.col("peak") <= tops)
    return out.select("doc_id", "lang", "n_grams", "perplexity", "peak", limits.alias("limit"), tops.alias("peak_limit"), F.coalesce(within | (F.col("n_grams") < FEWEST_GRAMS), F.lit(True)).alias("kept"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
