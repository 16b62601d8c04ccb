"""N-gram Jaccard join with vertical partitioning.

A document's set is its distinct 5-word shingles. All shingles stand in one global order: those that
many documents share come last, the rest go by hash. Two sets of n and m shingles with a Jaccard of 0.8
or more, n >= m, share `more(n)` shingles in their prefixes of 1 - 0.8 of their size and `more` besides, so only these are looked up,
and documents with fewer shared shingles there are done. Of the others, the rarest shared shingles make the posting
lists, as many as a linked pair must have one of in common. The order is cut into `FRAGMENTS` ranges; each document's set falls into segments, the
overlap of a candidate pair is counted in each fragment by itself, and the parts are summed for the pair and
held against the threshold exactly.

The result is the connected components of the links, so pairs are not expanded where a chain of links
already joins them. Equal sets are one class. In each posting list the first document is the hub. First
every document is held against the hub it shares most lists with, then every list's members against its
hub, if they are in other components. What lists still have several components fall into families that share no list. A family (or, if
that is less work, each of its lists) is cut into blocks of bounded size, and each pair of blocks is one unit of work: the partial overlaps
of its pairs are counted fragment by fragment as products of 0-1 matrices and summed, and only a spanning forest of the links leaves the unit.
So no link is lost to the components, pairs are never rows, and no task holds more than two blocks.

`link_counts` counts all links of each distinct set instead: every posting list goes into such units, without hubs
and whatever is joined already. In units of a family a pair stands once; in units of single lists it counts in the least
list that the two share.

Defined results: no words or null text: empty set, linked with nothing; fewer than five words: the whole
sequence is the one shingle; rows of one id with different texts are different sets, and component_id is the least
id reachable; a row with a null id is returned with a null component; an empty table gives no rows. Columns other than
id and text are passed through by `one_of_each` under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.packing import SCHEMA, cut_up, emit, pack, unpack_all
from strandmill.llm.shared import Tables, components, numbered
from strandmill.llm.textarrays import LOWER, SPACED, Slice, mix, slices, trim, windows_of, words_of

SHINGLE = 5
PERCENT = 80
FRAGMENTS = 8
HEAVY_AT_LEAST = 64
HEAVY_MOST = 1 << 19
EXTRA = 50
BUCKET_ROWS = 1_500_000
BLOCK_DOCS = 512
BLOCK_SHINGLES = 500_000
SLICE = 3 << 20


def shingle_sets(part: Slice, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text) of the distinct shingles, by text and hash, and the cuts between texts."""
    words = words_of(LOWER[part.data], part.offsets, SPACED)
    hashes, starts = windows_of(words, shingle, short_whole=True)
    owner = np.searchsorted(words.cuts, starts, "right") - 1
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint16) if len(part) < 1 << 16 else owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[new], owner[new]
    return hashes, owner, np.searchsorted(owner, np.arange(len(part) + 1))


def digests(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for a set."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)))])
        out.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
    return out[0], out[1]


class Order:
    """The global order: heavy shingles last, by how many documents have them; the others by hash."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray):
        by = np.argsort(heavy)
        self.heavy, self.weight = heavy[by], np.minimum(np.log2(np.maximum(counts[by], 1)).astype(np.uint8) + 1, 63)
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.heavy & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint8)
        if len(self.heavy):
            maybe = np.flatnonzero(self.bitmap[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.heavy, hashes[maybe]), len(self.heavy) - 1)
            found = self.heavy[at] == hashes[maybe]
            out[maybe[found]] = self.weight[at[found]]
        return out

    def fragments(self, hashes: np.ndarray, count: int) -> np.ndarray:
        """Ranges of the order: the heavy shingles are the last one, hash ranges the others."""
        light = (hashes >> np.uint64(32)) * np.uint64(count - 1) >> np.uint64(32)
        return np.where(self.weights(hashes) > 0, count - 1, light.astype(np.int64))


def _profile(rows: DataFrame, shingle: int) -> DataFrame:
    """kind 0: id, size and digests of each document; kind 1: shingles that several texts of a slice share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=SLICE):
            hashes, _, cuts = shingle_sets(part, shingle)
            a, b = digests(hashes, cuts)
            zero = pa.array(np.zeros(len(part), np.int8))
            yield pa.record_batch([zero, part.column("id"), pa.array(np.diff(cuts), pa.int64()), pa.array(a), pa.array(b)], names=["kind", "id", "n", "a", "b"])
            ordered = np.sort(hashes)
            at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
            count = np.diff(np.append(at, len(ordered)))
            many = count > 1
            if many.any():
                keys, none = ordered[at[many]].view(np.int64), pa.nulls(int(many.sum()), pa.int64())
                yield pa.record_batch([pa.array(np.ones(len(keys), np.int8)), pa.array(keys), pa.array(count[many], pa.int64()), none, none], names=["kind", "id", "n", "a", "b"])

    return rows.mapInArrow(run, "kind byte, id long, n long, a long, b long")


def more(n):
    """Shingles beyond the least prefix that are looked up; a linked set shares at least as many of them.

    Let n >= m be the sizes of two linked sets, with an overlap of at least ceil(p n). Prefixes that leave out less than
    the overlap by k share k shingles: n - ceil(p n) + k and m - ceil(p n) + k, which for k = more(n) are no longer than
    the prefixes looked up, as more(n) - ceil(p n) falls with n but for 1 of rounding, and the prefixes have 1 more."""
    return (EXTRA * n + 99) // 100


def _postings(rows: DataFrame, order, shingle: int, percent: int, buckets: int) -> DataFrame:
    """(id, n, sigs): the shared shingles that make the posting lists, of each document that may be linked."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        for part in slices(batches, max_bytes=SLICE):
            hashes, owner, cuts = shingle_sets(part, shingle)
            ids = np.asarray(part.column("id"))
            weight, size = known.weights(hashes), np.diff(cuts)
            if weight.any():
                by = np.argsort(weight, kind="stable")
                by = by[np.argsort(owner[by].astype(np.uint16) if len(part) < 1 << 16 else owner[by], kind="stable")]
                hashes, weight = hashes[by], weight[by]
            a, b = digests(hashes, cuts)
            same = np.lexsort((ids, b, a, size))  # of equal sets in a slice, the least id stands for all
            first = np.ones(len(ids), bool)
            first[same[1:]] = (a[same][1:] != a[same][:-1]) | (b[same][1:] != b[same][:-1]) | (size[same][1:] != size[same][:-1])
            prefix = size - (percent * size + 99) // 100 + 1 + more(size)
            place = np.arange(len(hashes)) - cuts[owner]
            some = np.flatnonzero((place < prefix[owner]) & first[owner])
            sig, of, heavy = hashes[some], owner[some], weight[some]
            # Heavy shingles are known to be shared: they need no meeting, and go straight to their documents.
            key = np.where(heavy > 0, -1 - (mix(ids[of].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), (mix(sig) % np.uint64(buckets)).astype(np.int64))
            by = np.lexsort((sig, key))
            sig, of, key, heavy = sig[by].view(np.int64), of[by], key[by], heavy[by].astype(np.int64)
            _, parts = cut_up(key)
            yield from emit([(k, pack([sig[low:high], ids[of[low:high]], size[of[low:high]], heavy[low:high]])) for k, low, high in parts])
        trim()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        sig, ids, size, count = unpack_all(table.column("blob").to_pylist(), 4)
        if key[0].as_py() >= 0:
            by = np.argsort(sig)
            sig, ids, size = sig[by], ids[by], size[by]
            at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            count = np.repeat(np.diff(np.append(at, len(sig))), np.diff(np.append(at, len(sig))))
            sig, ids, size, count = (x[count > 1] for x in (sig, ids, size, count))
        else:
            count = count + (1 << 32)
        group = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((ids, group))
        sig, ids, size, count = (x[by] for x in (sig, ids, size, count))
        _, parts = cut_up(group[by])
        found = [(k, pack([ids[low:high], size[low:high], sig[low:high], count[low:high]])) for k, low, high in parts]
        del sig, ids, size, count, by
        trim()
        return pa.table([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "blob"])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        ids, size, sig, count = unpack_all(table.column("blob").to_pylist(), 4)
        by = np.lexsort((sig, count, ids))  # the rarest first
        ids, size, sig = ids[by], size[by], sig[by]
        at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, np.int64)
        shared = np.diff(np.append(at, len(ids)))
        use = np.maximum(shared - more(size[at]) + 1, 0)
        place = np.arange(len(ids)) - np.repeat(at, shared)
        keep = place < np.repeat(use, shared)
        cuts = np.concatenate([[0], np.cumsum(use)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(sig[keep]))
        table = pa.table([pa.array(ids[at]), pa.array(size[at]), lists], names=["id", "n", "sigs"])
        return table.filter(pa.array(use > 0))

    return rows.mapInArrow(spread, SCHEMA).groupBy("bucket").applyInArrow(meet, SCHEMA).groupBy("bucket").applyInArrow(choose, "id long, n long, sigs array<long>")


def _segments(rows: DataFrame, order, shingle: int, fragments: int) -> DataFrame:
    """(id, fragment, segment) of the documents in candidate pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, owner, _ = shingle_sets(part, shingle)
            ids = np.asarray(part.column("id"))
            key = owner * fragments + order.value.fragments(hashes, fragments)
            by, parts = cut_up(key)
            cuts = np.array([low for _, low, _ in parts] + [len(by)], np.int32)
            keys = np.array([k for k, _, _ in parts], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[by].view(np.int64)))
            yield pa.record_batch([pa.array(ids[keys // fragments]), pa.array((keys % fragments).astype(np.int32)), lists], names=["id", "fragment", "segment"])

    return rows.mapInArrow(run, "id long, fragment int, segment array<long>")


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """pairs: u, v, un, vn. Partial overlaps by fragment, summed for each pair, against the threshold."""
    left = segments.select(F.col("id").alias("v"), "fragment", F.col("segment").alias("vs"))
    right = segments.select(F.col("id").alias("u"), "fragment", F.col("segment").alias("us"))
    part = pairs.join(left, "v").join(right, ["u", "fragment"]).select("u", "v", "un", "vn", F.size(F.array_intersect("us", "vs")).alias("part"))
    total = part.groupBy("u", "v", "un", "vn").agg(F.sum("part").alias("both"))
    return total.where(100 * F.col("both") >= percent * (F.col("un") + F.col("vn") - F.col("both"))).select("u", "v")


def _units(tables: Tables, held: DataFrame) -> DataFrame:
    """(g, i, j, side, id, n, comp): documents of each pair of blocks of each family or list. held: sig, id, n, comp."""
    size = held.groupBy("sig").agg(F.count("*").alias("m"), F.min("id").alias("hub"))
    held = tables.put("held", held.join(size, "sig"))
    family = components(tables, held.select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct())
    of = tables.put("families", held.join(family.select(F.col("node").alias("id"), F.col("label").alias("f")), "id", "left").withColumn("f", F.coalesce("f", "id")))
    docs = of.select("f", "id", "n", "comp").distinct()
    work = docs.groupBy("f").agg(F.count("*").alias("M"), F.sum("n").alias("total")).join(of.groupBy("f").agg(F.sum("m").alias("lists")), "f")
    whole = work.withColumn("whole", F.col("M") * F.col("M") <= F.col("lists"))
    one = docs.join(whole.where("whole"), "f").select(F.col("f").alias("g"), F.lit(0).alias("kind"), "id", "n", "comp", "M", "total")
    each = of.join(whole.where("NOT whole").select("f"), "f", "left_semi").drop("m")
    counts = each.groupBy("sig").agg(F.count("*").alias("M"), F.sum("n").alias("total"))
    many = each.join(counts, "sig").select(F.col("sig").alias("g"), F.lit(1).alias("kind"), "id", "n", "comp", "M", "total")
    blocks = F.greatest(F.ceil(F.col("M") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    cut = one.unionByName(many).withColumn("k", blocks).withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    spread = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return spread.select("g", "kind", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).alias("side"), "id", "n", "comp")


def _unit_links(units: DataFrame, segments: DataFrame, order, percent: int, fragments: int, *, totals: bool = False) -> DataFrame:
    """(u, v): a spanning forest of the links between the documents of each unit; with totals u and how many links v it has there.

    For totals the segments hold each document's lists besides, as fragment -1."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        ids_all, n_all = np.asarray(table.column("id").combine_chunks()), np.asarray(table.column("n").combine_chunks())
        ids, first, inverse = np.unique(ids_all, return_index=True, return_inverse=True)
        n, comp, right = n_all[first], np.asarray(table.column("comp").combine_chunks())[first], np.asarray(table.column("side").combine_chunks())[first]
        same = key[2].as_py() == key[3].as_py()
        left_rows, right_rows = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~right), np.flatnonzero(right))
        none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if not len(left_rows) or not len(right_rows):
            return none
        place = np.empty(len(ids), np.int64)
        place[left_rows] = np.arange(len(left_rows))
        other = np.empty(len(ids), np.int64)
        other[right_rows] = np.arange(len(right_rows))
        fragment = np.asarray(table.column("fragment").combine_chunks())
        lists = table.column("segment").combine_chunks()
        lengths = np.diff(np.asarray(lists.offsets))
        values, owner, of = np.asarray(lists.flatten()), np.repeat(inverse, lengths), np.repeat(fragment, lengths)

        def shared(some: np.ndarray) -> np.ndarray:
            """How many of some values each left and right document share."""
            both = np.zeros((len(left_rows), len(right_rows)), np.float32)
            own = owner[some]
            _, column = np.unique(values[some], return_inverse=True)
            wide = int(column.max()) + 1 if len(column) else 0
            by = np.argsort(column, kind="stable")
            own, column = own[by], column[by]
            for low in range(0, wide, 4096):
                a, b = np.searchsorted(column, (low, low + 4096))
                part = np.zeros((len(ids), min(4096, wide - low)), np.float32)
                part[own[a:b], column[a:b] - low] = 1
                both += part[left_rows] @ part[right_rows].T
            return both

        both = sum(shared(of == f) for f in range(fragments))
        linked = (100 * both >= percent * (n[left_rows][:, None] + n[right_rows][None, :] - both)) & (comp[left_rows][:, None] != comp[right_rows][None, :])
        if totals:
            if key[1].as_py():
                linked &= shared((of < 0) & (values < key[0].as_py())) == 0
            found = np.zeros(len(ids), np.int64)
            found[left_rows] += linked.sum(1)
            if not same:
                found[right_rows] += linked.sum(0)
            return pa.table({"u": pa.array(ids[found > 0]), "v": pa.array(found[found > 0])})
        label, rows, columns = ids.copy(), *np.nonzero(linked)
        if not len(rows):
            return none
        rows, columns = left_rows[rows], right_rows[columns]
        while True:
            now = label.copy()
            np.minimum.at(now, rows, label[columns])
            np.minimum.at(now, columns, now[rows])
            if (now == label).all():
                break
            label = now
        far = label != ids
        return pa.table({"u": pa.array(label[far]), "v": pa.array(ids[far])})

    ready = units.join(segments, "id").select("g", "kind", "i", "j", "side", "id", "n", "comp", "fragment", "segment")
    if totals:
        ready = ready.where("kind = 1 OR fragment >= 0")
    found = ready.groupBy("g", "kind", "i", "j").applyInArrow(count, "u long, v long")
    return found if totals else found.distinct()


def _candidates(tables: Tables, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, fragments: int) -> tuple:
    """The numbered rows and their ids, each number's class, the order, the posting lists of the classes, and the segments of those in lists."""
    spark = docs.sparkSession
    rows, back = numbered(tables, docs, id_col, text_col)
    profile = tables.put("profile", _profile(rows, shingle))
    one = profile.where("kind = 0").drop("kind")
    rep = one.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("rep"))
    members = one.join(rep, ["n", "a", "b"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    members = tables.put("members", members.distinct())
    size = one.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = max(HEAVY_AT_LEAST, size // HEAVY_MOST)  # so at most HEAVY_MOST of them: a proven bound
    heavy = profile.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    order = spark.sparkContext.broadcast(Order(np.array([r["id"] for r in heavy], np.int64).view(np.uint64), np.array([r["n"] for r in heavy], np.int64)))
    buckets = max(1, -(-size * (100 - percent + EXTRA) // 100 // BUCKET_ROWS))
    raw = tables.put("raw", _postings(rows, order, shingle, percent, buckets))
    reps = members.where("id = rep").select("id")
    likely = tables.put("likely", raw.join(reps, "id"))
    tables.free(raw)
    each = likely.select(F.explode("sigs").alias("sig"), "id", "n")
    lists = tables.put("lists", each.join(each.groupBy("sig").count().where("count > 1").select("sig"), "sig", "left_semi"))
    nodes = tables.put("nodes", lists.select("id").distinct())
    tables.free(likely)
    segments = tables.put("segments", _segments(rows.join(nodes, "id", "left_semi"), order, shingle, fragments))
    tables.free(profile)
    tables.free(nodes)
    return (rows, back), members, order, lists, segments


def classes_and_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, fragments: int = FRAGMENTS) -> tuple[tuple, DataFrame, DataFrame | None, DataFrame | None]:
    """The numbered rows, each number's class, the links between classes that join all that can be joined, and (node, label)."""
    tables = Tables(docs.sparkSession, "jaccard")
    own, members, order, lists, segments = _candidates(tables, docs, id_col, text_col, shingle, percent, fragments)
    forest: DataFrame | None = None
    links: DataFrame | None = None

    def with_components() -> DataFrame:
        if forest is None:
            return lists.withColumn("comp", F.col("id"))
        return lists.join(forest.select(F.col("node").alias("id"), "label"), "id", "left").select("sig", "id", "n", F.coalesce("label", "id").alias("comp"))

    def add(new: DataFrame) -> None:
        nonlocal forest, links
        new = tables.put("links", new)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            edges = new if forest is None else new.unionByName(forest.select(F.col("node").alias("u"), F.col("label").alias("v")))
            forest = components(tables, edges)

    for every in (False, True):
        held = with_components()
        alive = held.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min_by(F.struct("id", "n", "comp"), "id").alias("h")).where("c0 <> c1")
        met = held.join(alive.select(F.col("sig").alias("s"), F.col("h.id").alias("u"), F.col("h.n").alias("un"), F.col("h.comp").alias("uc")), (F.col("sig") == F.col("s")) & (F.col("comp") != F.col("uc")) & (100 * F.least("n", "un") >= percent * F.greatest("n", "un")))
        pairs = met.groupBy("u", F.col("id").alias("v"), "un", F.col("n").alias("vn")).agg(F.count("*").alias("shared"))
        if not every:
            pairs = pairs.groupBy("v", "vn").agg(F.max_by(F.struct("u", "un"), F.struct("shared", -F.col("u"))).alias("b")).select("b.u", "v", "b.un", "vn")
        pairs = tables.put("pairs", pairs.select("u", "v", "un", "vn"))
        add(_linked(pairs, segments, percent))
        tables.free(pairs)
        held = with_components()
        alive = held.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("id").alias("hub")).where("c0 <> c1").select("sig", "hub")
        left = held.join(alive, "sig")
        if every:
            left = left.where("id <> hub")  # a hub has met its list
        before, lists = lists, tables.put("lists", left.select("sig", "id", "n"))
        tables.free(before)
    if not lists.isEmpty():
        add(_unit_links(_units(tables, with_components()), segments, order, percent, fragments))
    tables.free(segments)
    return own, members, links, forest


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, rep) for each row; rep is the least id with the same set."""
    own, members, _, forest = classes_and_links(docs, id_col=id_col, text_col=text_col, **options)
    out = members
    if forest is not None:
        out = out.join(forest.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    else:
        out = out.withColumn("label", F.col("rep"))
    return _each_row(own, out.select("id", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), "rep"), "doc_id", "component_id", "rep")


def _each_row(own: tuple, out: DataFrame, *named: str) -> DataFrame:
    """The rows of out, by number, for each row of the input, repeated ones as often as they stand; the named columns hold ids again."""
    rows, back = own
    if back is None:
        return out.drop("id")
    for c in named:
        ids = back.select(F.col("id").alias(c), F.col("doc_id").alias("_own"))
        out = out.join(ids, c).drop(c).withColumnRenamed("_own", c)
    return rows.select("id").join(out, "id").drop("id")


def link_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, rep, is_rep, n_links) for each row with an id: n_links is with how many other distinct sets its set is
    linked, so the links between distinct sets are half the sum of n_links where is_rep. Of repeated rows each is_rep."""
    tables = Tables(docs.sparkSession, "jaccard")
    own, members, order, lists, segments = _candidates(tables, docs, id_col, text_col, shingle, percent, fragments)
    lines = lists.groupBy("id").agg(F.collect_set("sig").alias("segment")).select("id", F.lit(-1).alias("fragment"), "segment")
    units = _units(tables, lists.withColumn("comp", F.col("id")))
    parts = _unit_links(units, segments.unionByName(lines), order, percent, fragments, totals=True)
    counts = tables.put("counts", parts.groupBy("u").agg(F.sum("v").alias("n_links")))
    tables.free(segments)
    out = members.join(counts.withColumnRenamed("u", "rep"), "rep", "left")
    out = out.select("id", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "rep", (F.col("id") == F.col("rep")).alias("is_rep"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return _each_row(own, out, "doc_id", "rep")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows without those that belong to a component and aren't its least id. Rows of one id stay together;
    a row with a null id stays."""
    found = link_components(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["gone"], "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = link_components(docs).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside op6_jaccard_join, whose columns are those of its SQL: each document's class and its number of links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast("long")
    return link_counts(docs).unionByName(docs.where("doc_id IS NULL").select("doc_id", none.alias("n_shingles"), none.alias("rep"), F.lit(None).cast("boolean").alias("is_rep"), none.alias("n_links")))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS g FROM p
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT u, v FROM l UNION SELECT v, u FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
