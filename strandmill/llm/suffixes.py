"""Suffix-array deduplication by depth-limited most-significant-digit passes.

A byte goes if a string of `THRESHOLD` bytes that covers it also starts in a document
with a smaller id. Only the first `THRESHOLD` bytes of each suffix matter, so suffixes are ordered
by at most that depth, digit by digit; equal groups are exactly the repeated windows, and a group that has one
document left is not looked at again.

1. Between tasks, suffixes are dealt into buckets by a window's minimizer, the least hash of its `GRAM`-byte
   substrings. Equal windows have equal minimizers, so all that are equal meet in one bucket, and
   neighbouring windows with the same minimizer travel as one string. A string that also
   stands whole in a document with a smaller id of the same slice is settled there and does not travel, so a hot
   passage costs a bucket one string for each slice. Minimizers that a sample shows to be hot are dealt
   by the window itself, and first in `salts` parts, which send on only the windows they can't settle, so a
   window that stands in every document meets in parts of bounded size too. The sample decides the routing only.
2. In a bucket the suffixes are sorted by radix passes over their bytes, the most significant digit first. A digit is as many
   bytes as fit in 64 bits beside the number of the suffix's group, so each pass is one sort of whole numbers
   and the order is that of the bytes. Nothing is left to compare after the last pass.
3. Repeated windows go back to their documents, whose bytes are cut.

A bucket holds about `BUCKET_WINDOWS` windows whatever the size of the corpus: their number grows with it. A slice sends one blob to each
shelf, which is up to `SHELF` neighbouring buckets that one task settles one after the other: a blob for each bucket would be as many as slices
times buckets, so that most of the time went into ever smaller blobs.

Defined results: a null text is empty; texts of fewer than 50 bytes lose nothing; rows of one id don't
cut each other, and rows that are repeated get the same result; ids may be any long; rows with a null id are neither
cut nor a source; an empty table gives no rows. Other columns pass through `cut` under any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.packing import cut_up, pack, unpack
from strandmill.llm.shared import Tables, has_repeated_ids
from strandmill.llm.textarrays import Slice, covered, mix, prefix_hash, runs, slices, span_hash, text_arrays, trim, window_hash

THRESHOLD = 50
GRAM = 12
BUCKET_WINDOWS = 1_000_000
GROUP_BYTES = 6 << 20
SAMPLE_ONE_IN = 64
#: Buckets of a pass; a pass knows at most four hot minimizers for each.
PASS_BUCKETS = 1 << 20
SALT_BYTES = 4 << 30
#: Buckets of a shelf at most, and how many shelves there are before they get wider.
SHELF, SHELVES = 16, 64
SLICE = 2 << 20
_PLACE_BITS = 24
_PIECE = 1 << 23

DEALT = "bucket long, salt long, blob binary"  # a shelf of buckets; salt -1: settled, the bucket is a group of documents
SETTLED = "done boolean, bucket long, blob binary"


def least_grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least hash in each window of `width` places."""
    at = np.uint64((1 << _PLACE_BITS) - 1)
    low = (hashes & ~at) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    return (low & at).astype(np.int64)


def strings_of(data: np.ndarray, offsets: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, minimizer, running hash) of the strings of windows with one minimizer."""
    prefix = prefix_hash(data)
    size = np.diff(offsets)
    full = np.maximum(size - threshold + 1, 0)
    none = np.empty(0, np.int64)
    if not full.any():
        return none, none, none, np.empty(0, np.uint64), prefix
    grams = window_hash(prefix, gram)
    place = least_grams(grams, threshold - gram + 1)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full)
    starts = np.arange(int(full.sum())) + first
    least = place[starts]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    begin = starts[at]
    return np.searchsorted(offsets, begin, "right") - 1, begin, count, grams[least[at]], prefix


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = 0
    while at < len(ends):  # a part at a time: places take eight times the room of bytes
        base = int(ends[at] - lengths[at])
        upto = max(int(np.searchsorted(ends, base + (1 << 19), "right")), at + 1)
        n, size = int(ends[upto - 1]) - base, lengths[at:upto]
        out[base : base + n] = data[np.arange(n) + np.repeat(starts[at:upto] - (ends[at:upto] - size - base), size)]
        at = upto
    return out


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans at a and b hold the same bytes."""
    if not len(a):
        return np.empty(0, bool)
    differ = gather(data, a, lengths) != gather(data, b, lengths)
    total = np.concatenate([[0], np.cumsum(differ)])
    ends = np.cumsum(lengths)
    return total[ends] == total[ends - lengths]


def standing_whole(prefix: np.ndarray, data: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which strings are equal to one of a smaller id."""
    whole = span_hash(prefix, starts, starts + lengths)
    order = np.lexsort((ids, whole))
    ordered = whole[order]
    fresh = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    head = np.empty(len(order), np.int64)
    head[order] = np.repeat(order[fresh], np.diff(np.append(fresh, len(order))))
    found = np.flatnonzero((ids > ids[head]) & (lengths == lengths[head]))
    out = np.zeros(len(ids), bool)
    for k in range(0, len(found), 1 << 14):
        some = found[k : k + (1 << 14)]
        out[some] = equal_spans(data, starts[some], starts[head[some]], lengths[some])
    return out


def _tied(keys: np.ndarray) -> np.ndarray:
    """Places of the values that are there twice or more (and perhaps a few others)."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    place = lambda x: (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)
    seen = np.zeros(1 << 22, bool)
    seen[place(twice)] = True
    return np.flatnonzero(seen[place(keys)])


def big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, most significant first; zeros beyond the end. A view of the bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))


def equal_groups(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Radix passes over the suffixes at `starts`, the most significant digit first, down to `depth` bytes.

    Returns the suffixes (as places in `starts`) that are equal to one of another id to that depth, in the order of their bytes, and where
    each group of equal ones begins. Groups with one id are dropped after the pass that shows it."""
    words = big_endian(data)
    alive, group, groups, at = np.arange(len(starts)), np.zeros(len(starts), np.uint64), 1, 0
    cuts = np.zeros(0, np.int64)
    while at < depth and len(alive):
        width = min(8 - (max(groups - 1, 0).bit_length() + 7) // 8, depth - at)
        digit = words[starts[alive] + at].astype(np.uint64) >> np.uint64(64 - 8 * width)
        key = digit if groups == 1 else group << np.uint64(8 * width) | digit
        some = _tied(key)
        alive, key = alive[some], key[some]
        order = np.argsort(key)
        alive, key = alive[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        cuts, own = np.flatnonzero(new), ids[alive]
        if not len(cuts):
            break
        size = np.diff(np.append(cuts, len(alive)))
        several = np.minimum.reduceat(own, cuts) < np.maximum.reduceat(own, cuts)
        alive, groups = alive[np.repeat(several, size)], int(several.sum())
        group = np.repeat(np.arange(groups, dtype=np.uint64), size[several])
        cuts = np.concatenate([[0], np.cumsum(size[several])])[:-1]
        at += width
    return alive, cuts


def repeated_windows(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, threshold: int) -> np.ndarray:
    """Flags of the windows at `starts` that also start in a text with a smaller id."""
    out = np.zeros(len(starts), bool)
    alive, cuts = equal_groups(data, starts, ids, threshold)
    if len(alive):
        own = ids[alive]
        out[alive] = own > np.repeat(np.minimum.reduceat(own, cuts), np.diff(np.append(cuts, len(alive))))
    return out


def _pieces(part: Slice, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A slice, or overlapping pieces of a long text: (bytes, offsets, place in the slice)."""
    if len(part.data) <= _PIECE:
        yield part.data, part.offsets, 0
        return
    for at in range(0, len(part.data), _PIECE - threshold):
        end = min(at + _PIECE - 1, len(part.data))
        yield part.data[at:end], np.clip(part.offsets, at, end) - at, at
        if end == len(part.data):
            return


def in_pass(grams: np.ndarray, k: int, passes: int) -> np.ndarray:
    """Which minimizers a pass deals with."""
    return mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(passes) == np.uint64(k)


def hot_grams(rows: DataFrame, threshold: int, gram: int, limit: int, k: int = 0, passes: int = 1) -> np.ndarray:
    """Minimizers of a pass that would fill over a quarter of a bucket, judged by one document in `SAMPLE_ONE_IN`.

    At most 4 * windows / limit of them can exist, four for each bucket, and a pass has at most `PASS_BUCKETS`: 32 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=SLICE):
            for data, offsets, _ in _pieces(part, threshold):
                _, _, count, gram_hash, _ = strings_of(data, offsets, threshold, gram)
                if passes > 1:
                    own = in_pass(gram_hash, k, passes)
                    count, gram_hash = count[own], gram_hash[own]
                order, parts = cut_up(gram_hash.view(np.int64))
                total = np.concatenate([[0], np.cumsum(count[order])])
                keys, n = [x for x, _, _ in parts], [int(total[b] - total[a]) for _, a, b in parts]
                some = np.array(n) > limit / SAMPLE_ONE_IN / 64
                if some.any():
                    yield pa.record_batch([pa.array(np.array(keys)[some]), pa.array(np.array(n)[some])], names=["gram", "n"])

    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_ONE_IN)) == 0)
    found = sample.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > limit / SAMPLE_ONE_IN / 4)
    return np.sort(np.array([r["gram"] for r in found.collect()], np.int64).view(np.uint64))


def shelf_width(buckets: int) -> int:
    """How many buckets travel together."""
    return min(max(buckets // SHELVES, 1), SHELF)


def _emit(found: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(found), 512):
        some = found[k : k + 512]
        yield pa.record_batch([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.binary())], names=["bucket", "salt", "blob"])


def repeats(tables: Tables, rows: DataFrame, groups: int, *, threshold: int, gram: int, bucket_windows: int, total: int, salts: int) -> DataFrame:
    """(bucket: a group of documents, blob: id, variant, start, windows) of the repeated windows. rows: id, variant, text.

    Each pass over the texts deals with the windows of some minimizers, so that what is known of hot ones is bounded; up to 1 TB it is one pass."""
    buckets = max(1, -(-total // bucket_windows))
    passes = -(-buckets // PASS_BUCKETS)
    parts = [_repeats(tables, rows, groups, threshold=threshold, gram=gram, bucket_windows=bucket_windows, buckets=-(-buckets // passes), salts=salts, k=k, passes=passes) for k in range(passes)]
    if passes == 1:
        return parts[0]
    out, *rest = (tables.put("pass", p) for p in parts)
    for x in rest:
        out = out.unionByName(x)
    return out


def _repeats(tables: Tables, rows: DataFrame, groups: int, *, threshold: int, gram: int, bucket_windows: int, buckets: int, salts: int, k: int, passes: int) -> DataFrame:
    hot = hot_grams(rows, threshold, gram, bucket_windows, k, passes) if buckets * passes > 1 else np.empty(0, np.uint64)
    known, wide = rows.sparkSession.sparkContext.broadcast(hot), shelf_width(buckets)
    shelves = -(-buckets // wide)

    def back(ids: np.ndarray, variant: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[tuple[int, bytes]]:
        order, parts = cut_up(group_of(ids, variant, groups))
        return [(group, pack([ids[o], variant[o], start[o], count[o]])) for group, a, b in parts for o in [order[a:b]]]

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warm, task = known.value, TaskContext.get()
        salt = 1 + (task.partitionId() if task else 0) % salts
        for part in slices(batches, max_bytes=SLICE):
            names, kinds = np.asarray(part.column("id")), np.asarray(part.column("variant"))
            for data, offsets, base in _pieces(part, threshold):
                owner, start, count, grams, prefix = strings_of(data, offsets, threshold, gram)
                if passes > 1:
                    own = in_pass(grams, k, passes)
                    owner, start, count, grams = owner[own], start[own], count[own], grams[own]
                if not len(owner):
                    continue
                length = count + threshold - 1
                # Strings that stand whole in a text of a smaller id, in this slice.
                whole = standing_whole(prefix, data, names[owner], start, length)
                settled = np.flatnonzero(whole)
                if len(settled):
                    of = owner[settled]
                    yield from _emit([(group, -1, b) for group, b in back(names[of], kinds[of], start[settled] + base - part.offsets[of], count[settled])])
                start, count, grams, length, owner = (x[~whole] for x in (start, count, grams, length, owner))
                bucket = (mix(grams) % np.uint64(buckets)).astype(np.int64)
                cold = len(owner)
                if len(warm):
                    at = np.minimum(np.searchsorted(warm, grams), len(warm) - 1)
                    is_hot = warm[at] == grams
                    if is_hot.any():  # each window by itself
                        n = count[is_hot]
                        each = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[is_hot], n)
                        alone = (mix(span_hash(prefix, each, each + threshold)) % np.uint64(buckets)).astype(np.int64)
                        owner = np.concatenate([owner[~is_hot], np.repeat(owner[is_hot], n)])
                        bucket = np.concatenate([bucket[~is_hot], alone + shelves * wide])
                        start = np.concatenate([start[~is_hot], each])
                        count = np.concatenate([count[~is_hot], np.ones(len(each), np.int64)])
                order, _ = cut_up(bucket)
                bucket, owner, start, count = bucket[order], owner[order], start[order], count[order]
                _, parts = cut_up(bucket // wide)
                ids, variant, place = names[owner], kinds[owner], start + base - part.offsets[owner]
                strings = gather(data, start, count + threshold - 1)
                ends = np.concatenate([[0], np.cumsum(count + threshold - 1)])
                for at in range(0, len(parts), 512):
                    yield from _emit([(of, salt if of >= shelves else 0, pack([ids[a:b], variant[a:b], place[a:b], count[a:b], bucket[a:b] % wide], strings[ends[a] : ends[b]])) for of, a, b in parts[at : at + 512]])
        trim()

    def in_bucket(ids: np.ndarray, variant: np.ndarray, place: np.ndarray, count: np.ndarray, data: np.ndarray, part: bool) -> tuple[list, list]:
        """The repeated windows among a bucket's strings, as columns of `back`, and the columns and bytes of the strings that a part of a hot bucket leaves open."""
        length = count + threshold - 1
        begin = np.cumsum(length) - length
        whole = standing_whole(prefix_hash(data), data, ids, begin, length)
        found = [(ids[whole], variant[whole], place[whole], count[whole])]
        ids, variant, place, count, begin = (x[~whole] for x in (ids, variant, place, count, begin))
        first = np.cumsum(count) - count
        windows = np.arange(int(count.sum())) + np.repeat(begin - first, count)
        flags = repeated_windows(data, windows, np.repeat(ids, count), threshold)
        # A run of flags ends with its string.
        fresh = np.zeros(len(flags) + 1, bool)
        fresh[first] = fresh[-1] = True
        a = np.flatnonzero(flags & (fresh[:-1] | ~np.concatenate([[False], flags[:-1]])))
        b = np.flatnonzero(flags & (fresh[1:] | ~np.concatenate([flags[1:], [False]]))) + 1
        of = np.searchsorted(first, a, "right") - 1
        found.append((ids[of], variant[of], place[of] + a - first[of], b - a))
        if not part:
            return found, []
        open_ = np.flatnonzero(~flags)  # their strings are one window each
        return found, [ids[open_], variant[open_], place[open_], count[open_], gather(data, begin[open_], count[open_] + threshold - 1)]

    def settle(key: tuple, table: pa.Table, last: bool) -> pa.Table:
        blobs, left = table.column("blob").to_pylist(), []
        if key[1].as_py() < 0:
            found = [(key[0].as_py(), b) for b in blobs]
        else:
            part, repeated, open_ = not last and key[1].as_py() > 0, [], []
            parts = [unpack(b) for b in blobs]
            del blobs
            # Strings lie in the order of their buckets within each blob, so a bucket's are one run of its columns and bytes.
            cuts = [np.searchsorted(p[0][4], np.arange(wide + 1)) for p in parts]
            ends = [np.concatenate([[0], np.cumsum(p[0][3] + threshold - 1)]) for p in parts]
            for bucket in range(wide):
                runs_ = [(p, c[bucket], c[bucket + 1], e) for p, c, e in zip(parts, cuts, ends, strict=True) if c[bucket] < c[bucket + 1]]
                if not runs_:
                    continue
                columns = [np.concatenate([p[0][k][a:b] for p, a, b, _ in runs_]) for k in range(4)]
                some, rest = in_bucket(*columns, np.concatenate([p[1][e[a] : e[b]] for p, a, b, e in runs_]), part)
                repeated += some
                if rest:
                    open_.append((*rest[:4], np.full(len(rest[0]), bucket), rest[4]))
            found = back(*(np.concatenate([x[k] for x in repeated]) for k in range(4))) if repeated else []
            if open_:
                left = [(key[0].as_py(), pack([np.concatenate([x[k] for x in open_]) for k in range(5)], np.concatenate([x[5] for x in open_])))]
            del parts, cuts, ends, repeated, open_
            trim()
        rows = [(True, *x) for x in found] + [(False, *x) for x in left]
        return pa.table([pa.array([x[0] for x in rows], pa.bool_()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())], names=["done", "bucket", "blob"])

    dealt = rows.where("id IS NOT NULL").mapInArrow(spread_out, DEALT).groupBy("bucket", "salt")
    if salts == 1:
        return dealt.applyInArrow(lambda key, table: settle(key, table, True), SETTLED).drop("done")
    first = tables.put("settled", dealt.applyInArrow(lambda key, table: settle(key, table, False), SETTLED))
    again = first.where("NOT done").withColumn("salt", F.lit(0).cast("long")).drop("done").groupBy("bucket", "salt")
    return first.where("done").drop("done").unionByName(again.applyInArrow(lambda key, table: settle(key, table, True), SETTLED).drop("done"))


def group_of(ids: np.ndarray, variant: np.ndarray, groups: int) -> np.ndarray:
    return (mix(mix(ids.astype(np.int64).view(np.uint64)) ^ variant.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _codes(*pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Numbers for pairs of numbers, equal where the pairs are, for each of the given lists."""
    a, b = (np.concatenate([p[k] for p in pairs]) for k in range(2))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(order) else 0
    return np.split(code, np.cumsum([len(p[0]) for p in pairs])[:-1])


def _cut_texts(docs: DataFrame, id_col: str, text_col: str, schema: T.StructType, make: Callable, *, threshold: int, gram: int, bucket_windows: int, salts: int | None) -> DataFrame:
    """Applies make(rows, offsets, bytes, flags of removed bytes) to groups of documents."""
    spark = docs.sparkSession
    # Rows of one id with different texts are told apart by a hash of the text, if there are any.
    variant = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if has_repeated_ids(docs, id_col) else F.lit(0).cast("long")
    rows = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_variant", variant)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()["b"] or 0
    groups, salts = max(1, -(-total // GROUP_BYTES)), salts or max(1, -(-total // SALT_BYTES))
    tables = Tables(spark, "suffixes")
    narrow = rows.select(F.col("_id").alias("id"), F.col("_variant").alias("variant"), F.col(text_col).alias("text"))
    found = tables.put("repeats", repeats(tables, narrow, groups, threshold=threshold, gram=gram, bucket_windows=bucket_windows, total=total, salts=salts))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 2)
            missing = ~np.asarray(column.is_valid())
            group = group_of(np.asarray(column.fill_null(0)), np.asarray(batch.column(batch.num_columns - 1)), groups)
            group[missing] = np.arange(missing.sum()) % groups  # rows without an id are spread
            yield batch.append_column("_group", pa.array(group))

    wide = T.StructType([*rows.schema.fields, T.StructField("_group", T.LongType())])
    grouped = rows.mapInArrow(assign, wide)

    def cut(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        out = []
        ids, kinds, start, count = (np.empty(0, np.int64),) * 4
        if blobs.num_rows:
            parts = [unpack(b)[0] for b in blobs.column("blob").to_pylist()]
            ids, kinds, start, count = (np.concatenate([p[k] for p in parts]) for k in range(4))
        for batch in texts.combine_chunks().to_batches():
            offsets, data, _ = text_arrays(batch.column(batch.schema.get_field_index(text_col)))
            names = batch.column(batch.schema.get_field_index("_id"))
            there, own = _codes((ids, kinds), (np.asarray(names.fill_null(0)), np.asarray(batch.column(batch.schema.get_field_index("_variant")))))
            order = np.argsort(there, kind="stable")
            there = there[order]
            low, high = np.searchsorted(there, own, "left"), np.searchsorted(there, own, "right")
            high[~np.asarray(names.is_valid())] = 0
            n = np.maximum(high - low, 0)
            at = order[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)]
            begin = start[at] + np.repeat(offsets[:-1], n)
            out.append(make(batch, offsets, data, covered(begin, begin + count[at] + threshold - 1, len(data))))
        return pa.concat_tables([pa.Table.from_batches([x]) for x in out]) if out else pa.table({f.name: pa.array([], pa.null()) for f in schema.fields})

    return grouped.groupBy("_group").cogroup(found.withColumnRenamed("bucket", "_group").groupBy("_group")).applyInArrow(cut, schema)


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, bucket_windows: int = BUCKET_WINDOWS, salts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, the removed spans [span_start, span_end) in bytes, and the bytes that are kept."""
    schema = T._parse_datatype_string("doc_id long, n_bytes long, span_start array<long>, span_end array<long>, kept binary")

    def make(batch: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        lists, texts = [], []
        for low, high in zip(offsets, offsets[1:], strict=False):
            lists.append(runs(gone[low:high]))
            texts.append(data[low:high][~gone[low:high]].tobytes())
        kinds = pa.list_(pa.int64())
        return pa.record_batch([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array([a for a, _ in lists], kinds), pa.array([b for _, b in lists], kinds), pa.array(texts, pa.binary())], names=schema.names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _cut_texts(narrow, "doc_id", "text", schema, make, threshold=threshold, gram=gram, bucket_windows=bucket_windows, salts=salts)


def cut(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, bucket_windows: int = BUCKET_WINDOWS, salts: int | None = None) -> DataFrame:
    """The input's rows with repeats cut from their texts; characters cut in part go too, and rows that lose their whole text."""
    # Columns go by place, so their names can't clash with ours.
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    place, key, width = docs.columns.index(text_col), docs.columns.index(id_col), len(docs.columns)

    def make(batch: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        rows = batch.select(list(range(width)))
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[offsets[1:]] - total[offsets[:-1]]
        if not removed.any():
            return rows
        texts = rows.column(place).to_pylist()
        for i in np.flatnonzero(removed):
            low, high = offsets[i], offsets[i + 1]
            texts[i] = data[low:high][~gone[low:high]].tobytes().decode("utf-8", "ignore")
        keep = (removed == 0) | (removed < np.diff(offsets))
        return rows.set_column(place, rows.schema.field(place), pa.array(texts, rows.schema.field(place).type)).filter(pa.array(keep))

    out = _cut_texts(plain, f"c{key}", f"c{place}", plain.schema, make, threshold=threshold, gram=gram, bucket_windows=bucket_windows, salts=salts)
    return out.toDF(*docs.columns)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate(F.zip_with("span_start", "span_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("span_start").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), p AS (
  SELECT doc_id, unnest(range(0, n - 49)) AS s, h FROM d WHERE n >= 50
), w AS (
  SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS win FROM p
), f AS (
  SELECT win, min(doc_id) AS first_doc FROM w GROUP BY win
), r AS (
  SELECT w.doc_id, w.s FROM w JOIN f USING (win) WHERE f.first_doc < w.doc_id
), g AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM r
), k AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g
), sp AS (
  SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM k GROUP BY doc_id, run
), edges AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM sp
), kept AS (
  SELECT e.doc_id, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head,
         max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM edges e JOIN d USING (doc_id) GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(d.h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
