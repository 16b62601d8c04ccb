"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes into tokens. The transducer reads tokens of both sides in turn; its state is which side leads and
the bytes by which it leads (the residual). At level, side A reads; else the side that lags. A transition depends on the
residual and the token that is read alone, so it is worked out once (`Transducer.move`) and looked up from then on. Every read that starts with a
residual links the token that was read with the token that the residual belongs to; an empty residual closes a group.

A run may start wherever both sides begin a token. Texts are tokenized whole and then cut at blanks of that kind, and the
runs of a slice step together: one NumPy step reads the next token of each. What is left of a few long runs is read token by token.

A link's count is the number of documents that hold its pair of ids linked. Documents of a slice are counted together before
anything is shuffled: a slice asks once for each distinct pair, whatever the number of its documents, so no id is a hot key. Counts
are summed in a tree by bucket of the A id, answers go back to the slices, and each slice adds up its documents.

Defined results: null and empty texts, and texts whose joined tokens of either side differ from space + text, have
no tokens: zeros and an empty groups_sha256. Strings of special tokens are plain text. Repeated rows are documents of their own; rows without
an id are kept; an empty table gives no rows. Only the id and text columns are read. Memory: one slice (2 MB of text, or one longer text) and
the transitions (states are ends of tokens, so their number is bounded by the vocabularies).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.bpe import ByteBPE
from strandmill.llm.bpe import default_path as byte_path
from strandmill.llm.packing import cut_up, pack, tree_rounds, tree_sum, unpack
from strandmill.llm.shared import Tables, partitions_of
from strandmill.llm.textarrays import Slice, slices, sums, trim

BUCKETS = 64
_ID_BITS = 32
#: With fewer runs than this left in a step, each is read to its end by itself.
FEW_RUNS = 48
_SLOT_BITS = 20
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True

ALIGNED = "slice long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, entries array<int>, found binary, pairs binary"
REQUEST = "bucket long, part long, slice long, blob binary, places binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Transducer:
    """states: (lead, residual), lead 1 for side A and 2 for side B; state 0 is level. moves has the next state by state and token;
    the latest ones stand in a table too (`slots`), one for each hash of state and token, where a whole step looks them up at once."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.tokens, self.states, self.index = {1: a, 2: b}, [(0, b"")], {(0, b""): 0}
        self.bits = max(len(a), len(b)).bit_length()
        self.moves: dict[int, int] = {}
        self.a_leads = np.zeros(1, bool)
        self.slots, self.next = np.full(1 << _SLOT_BITS, -1, np.int64), np.zeros(1 << _SLOT_BITS, np.int64)

    def move(self, key: int) -> int:
        """The state after a state and the token that is read in it."""
        state, token = key >> self.bits, key & ((1 << self.bits) - 1)
        lead, residual = self.states[state]
        reads = 2 if lead == 1 else 1
        text = self.tokens[reads][token]
        if residual.startswith(text):
            rest = (lead, residual[len(text) :])
        elif text.startswith(residual):
            rest = (reads, text[len(residual) :])
        else:
            raise ValueError("the two sides are not the same bytes")
        rest = rest if rest[1] else (0, b"")
        if rest not in self.index:
            self.index[rest] = len(self.states)
            self.states.append(rest)
            if len(self.states) > len(self.a_leads):
                self.a_leads = np.concatenate([self.a_leads, np.zeros(len(self.a_leads), bool)])
            self.a_leads[self.index[rest]] = rest[0] == 1
        found = self.moves[key] = self.index[rest]
        return found

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The next states of many."""
        slot = ((keys * 0x9E3779B1) >> 7) & ((1 << _SLOT_BITS) - 1)
        out = self.next[slot]
        if len(miss := np.flatnonzero(self.slots[slot] != keys)):
            wanted, where = np.unique(keys[miss], return_inverse=True)
            found = np.array([self.moves[k] if k in self.moves else self.move(k) for k in wanted.tolist()], np.int64)
            out[miss] = found[where]
            self.slots[slot[miss]] = keys[miss]
            # Of several keys with one slot the same one has to stand in both tables.
            self.next[slot[miss]] = found[np.searchsorted(wanted, self.slots[slot[miss]])]
        return out

    def run(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links as places in A and in B, and whether each token of A and of B is the last of its group.

        Runs are a[a_cuts[k] : a_cuts[k + 1]] and b alike, of the same bytes."""
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        size = np.diff(a_cuts) + np.diff(b_cuts)
        order = np.argsort(-size, kind="stable")
        i, j, left = a_cuts[:-1][order].copy(), b_cuts[:-1][order].copy(), size[order]
        state = np.zeros(len(order), np.int64)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        done = 0
        while (n := int(np.searchsorted(-left, -done, "left"))) >= FEW_RUNS:  # runs with more than `done` tokens come first
            i, j, state = i[:n], j[:n], state[:n]
            before, reads_b = state, self.a_leads[state]
            # A side that has no token left isn't read: its place is clipped only to look at something.
            token = np.where(reads_b, b[np.minimum(j, len(b) - 1)], a[np.minimum(i, len(a) - 1)])
            state = self.step((before << self.bits) | token)
            i, j = i + ~reads_b, j + reads_b
            tied = before != 0
            links.append((i[tied] - 1, j[tied] - 1))
            closed = state == 0
            last_a[i[closed] - 1] = True
            last_b[j[closed] - 1] = True
            done += 1
        for x, y, s, rest in zip(i[:n].tolist(), j[:n].tolist(), state[:n].tolist(), (left[:n] - done).tolist(), strict=True):
            places = np.empty((rest, 2), np.int64)
            count = 0
            for _ in range(rest):
                before = s
                if self.a_leads[s]:
                    key, y = s << self.bits | int(b[y]), y + 1
                else:
                    key, x = s << self.bits | int(a[x]), x + 1
                s = self.moves[key] if key in self.moves else self.move(key)
                if before:
                    places[count] = x - 1, y - 1
                    count += 1
                if not s:
                    last_a[x - 1] = last_b[y - 1] = True
            links.append((places[:count, 0], places[:count, 1]))
        none = np.empty(0, np.int64)
        return np.concatenate([none, *(x for x, _ in links)]), np.concatenate([none, *(y for _, y in links)]), last_a, last_b


@dataclass
class Aligned:
    """Texts of a slice: ids of both sides, cuts between texts, which tokens end a group, and links as places."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def shown(self) -> list[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        if not len(self.a):
            return [b""] * (len(self.a_cuts) - 1)
        ends_a, ends_b = np.flatnonzero(self.last_a) + 1, np.flatnonzero(self.last_b) + 1  # as many of one as of the other
        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        place_a = np.arange(len(self.a)) + np.concatenate([[0], ends_b])[group_a]
        place_b = np.arange(len(self.b)) + ends_a[group_b]
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[self.last_a]], mark[place_b[self.last_b]] = ord("|"), ord(";")
        width = len(str(int(ids.max())))
        digits = np.empty((n, width + 1), np.uint8)
        digits[:, width] = mark
        keep = np.ones((n, width + 1), bool)
        rest = ids
        for k in range(width - 1, -1, -1):
            rest, digit = np.divmod(rest, 10)
            digits[:, k] = digit + ord("0")
            if k:
                keep[:, k - 1] = rest > 0
        flat = digits[keep].tobytes()
        cuts = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])[self.a_cuts + self.b_cuts].tolist()
        return [flat[x : y - 1] if y > x else b"" for x, y in zip(cuts, cuts[1:], strict=False)]


class Pair:
    """Tokenizer A (a byte-level BPE file) and tokenizer B (a sentencepiece model) in one worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ByteBPE(path_a)
        self.a.cut, self.a.library.encode_special_tokens = None, True  # special tokens' strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sides = [(np.array([len(x) for x in side], np.int64), np.frombuffer(b"".join(side), np.uint8)) for side in (self.a.by_id, self.bytes_b)]
        self.transducer = Transducer(self.a.by_id, self.bytes_b)

    def joined(self, side: int, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        lengths, pool = self.sides[side]
        starts = np.cumsum(lengths) - lengths
        n = lengths[ids]
        return pool[np.arange(n.sum()) + np.repeat(starts[ids] - np.cumsum(n) + n, n)]

    def align(self, part: Slice) -> Aligned:
        filled = np.flatnonzero(np.diff(part.offsets) > 0)
        texts = [part.text(k) for k in filled]
        data = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        a = [x.astype(np.int64) for x in self.a.encode_slice(Slice(part.rows, offsets, data, np.ones(len(texts), bool)))]
        b = [np.array(x, np.int64) for x in self.b.encode([t.decode() for t in texts], num_threads=1)] if texts else []
        whole = lambda side, ids, k: np.array_equal(self.joined(side, ids), data[offsets[k] : offsets[k + 1]])
        good = np.array([whole(0, x, k) and whole(1, y, k) for k, (x, y) in enumerate(zip(a, b, strict=True))], bool)
        none, kept = np.empty(0, np.int64), np.flatnonzero(good)
        sizes = np.zeros((2, len(part)), np.int64)
        sizes[:, filled[kept]] = [[len(side[k]) for k in kept] for side in (a, b)]
        a_cuts, b_cuts = (np.concatenate([[0], np.cumsum(s)]) for s in sizes)
        a, b = (np.concatenate([none, *(side[k] for k in kept)]) for side in (a, b))
        data = np.concatenate([np.empty(0, np.uint8), *(data[offsets[k] : offsets[k + 1]] for k in kept)])
        ends_a, ends_b = (np.concatenate([[0], np.cumsum(lengths[ids])]) for (lengths, _), ids in zip(self.sides, (a, b), strict=True))
        # Runs start at the texts' first bytes, and at blanks between visible characters where both sides begin a token.
        blank = np.flatnonzero((data[1:-1] == 32) & _VISIBLE[data[:-2]] & _VISIBLE[data[2:]]) + 1
        at_a, at_b = np.searchsorted(ends_a, blank), np.searchsorted(ends_b, blank)
        both = (ends_a[at_a] == blank) & (ends_b[at_b] == blank)
        runs_a, runs_b = np.union1d(at_a[both], a_cuts), np.union1d(at_b[both], b_cuts)
        link_a, link_b, last_a, last_b = self.transducer.run(a, b, runs_a, runs_b)
        return Aligned(a, b, a_cuts, b_cuts, last_a, last_b, link_a, link_b)


_LOADED: dict[tuple[str, str], Pair] = {}


def loaded(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers for each worker process."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Pair(path_a, path_b)
    return _LOADED[path_a, path_b]


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, *, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, groups: of each group its ids of A and of B, in order; null for a text without tokens. The plain output, without counts."""
    path_a, path_b = path_a or byte_path(), path_b or piece_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(path_a, path_b)
        ids = lambda x: list(map(int, x.split(b",")))
        for part in slices(batches):
            groups = [[dict(zip("ab", map(ids, g.split(b"|")), strict=True)) for g in s.split(b";")] if s else None for s in pair.align(part).shown()]
            yield pa.record_batch([part.column("doc_id"), pa.array(groups, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))], names=["doc_id", "groups"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def _aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """One row for each slice of texts: figures of its documents, their distinct pairs with how often each is linked (`found`), and the slice's distinct pairs with how many of its documents hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task = loaded(path_a, path_b), TaskContext.get()
        place = (task.partitionId() if task else 0) << 32
        schema = pa.schema([("slice", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("ids", "n_a", "n_b", "n_groups")), ("digests", pa.list_(pa.string())), ("entries", pa.list_(pa.int32())), ("found", pa.binary()), ("pairs", pa.binary())])
        for part in slices(batches):
            x = pair.align(part)
            owner = np.searchsorted(x.a_cuts, x.link_a, "right") - 1
            links = (x.a[x.link_a] << _ID_BITS) | x.b[x.link_b]
            # Sorted by text and pair: a text's links of one pair stand together.
            distinct, number = np.unique(links, return_inverse=True)
            width = max(len(distinct), 1)
            key, times = np.unique(owner * width + number, return_counts=True)
            held = np.bincount(key % width, minlength=len(distinct)).astype(np.int64)
            entries = np.bincount(key // width, minlength=len(part))
            digests = [hashlib.sha256(s).hexdigest() if s else "" for s in x.shown()]
            counts = (np.diff(x.a_cuts), np.diff(x.b_cuts), sums(x.last_a, x.a_cuts))
            values = [place, part.column("doc_id").to_pylist(), *(c.tolist() for c in counts), digests, entries.tolist(), pack([key % width, times.astype(np.int64)]), pack([distinct, held])]
            place += 1
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ALIGNED)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's pairs by bucket of their A id: pairs and numbers of documents, and their places among the slice's pairs."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    for batch in batches:
        for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (pairs, held), _ = unpack(blob)
            order, cuts = cut_up((pairs >> _ID_BITS) % BUCKETS)
            rows = [(bucket, part, name, pack([pairs[order[x:y]], held[order[x:y]]]), pack([order[x:y]])) for bucket, x, y in cuts]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "part", "slice", "blob", "places"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs that were asked for, and whether each is the highest of its A id."""
    bucket, pairs, counts, best = None, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            now, name, blob, places, total = (batch.column(c)[k].as_py() for c in range(5))
            if now != bucket:
                (pairs, counts), _ = unpack(total)
                _, cuts = cut_up(pairs >> _ID_BITS)  # sorted already
                starts = np.array([x for _, x, _ in cuts], np.int64)
                sizes = np.diff(np.append(starts, len(pairs)))
                best = (counts == np.repeat(np.maximum.reduceat(counts, starts), sizes)).astype(np.int64)
                bucket = now
            at = np.searchsorted(pairs, unpack(blob)[0][0])
            yield pa.record_batch([pa.array([name], pa.int64()), pa.array([pack([unpack(places)[0][0], counts[at], best[at]])], pa.binary())], names=["slice", "answer"])


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    """The documents of one slice, from its row and the answers it got."""
    own = next(r for r in table.to_pylist() if r["ids"] is not None)
    parts = [unpack(b)[0] for b in table.column("answer").to_pylist() if b is not None]
    (which, times), _ = unpack(own["found"])
    counts, best = np.zeros(sum(len(p[0]) for p in parts), np.int64), np.zeros(sum(len(p[0]) for p in parts), np.int64)
    for places, n, top in parts:
        counts[places], best[places] = n, top
    cuts = np.concatenate([[0], np.cumsum(own["entries"], dtype=np.int64)])
    n_a, n_b, groups = (np.array(own[c], np.int64) for c in ("n_a", "n_b", "n_groups"))
    columns = [n_a, n_b, groups, n_a + n_b - groups, sums(times * best[which], cuts), sums(times * counts[which], cuts)]
    return pa.table([pa.array(own["ids"], pa.int64()), *map(pa.array, columns), pa.array(own["digests"], pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])


def link_counts(docs: DataFrame, *, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: tokens of both sides, groups, links, links whose count is the highest of their A id, the sum of the links' counts, and the digest of the groups."""
    spark = docs.sparkSession
    tables = Tables(spark, "alignment")
    aligned = tables.put("aligned", _aligned(docs, path_a or byte_path(), path_b or piece_path(), id_col, text_col))
    asked = aligned.select("slice", "pairs").mapInArrow(_asked, REQUEST)
    rounds = tree_rounds(max(partitions_of(spark), len(aligned.inputFiles())))
    counts = tree_sum(asked.select("bucket", "part", "blob"), {"bucket": pa.int64()}, rounds)
    counts = tables.put("counts", counts)
    # Sorted within a task, so that a bucket's counts are opened once there.
    joined = asked.join(counts.withColumnRenamed("blob", "total"), "bucket").select("bucket", "slice", "blob", "places", "total")
    answers = joined.sortWithinPartitions("bucket").mapInArrow(_answers, "slice long, answer binary")
    own = aligned.drop("pairs").withColumn("answer", F.lit(None).cast("binary"))
    both = own.unionByName(answers, allowMissingColumns=True)
    return both.groupBy("slice").applyInArrow(_summed, RESULT)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
