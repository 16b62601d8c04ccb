"""Vector code compression by Heap Lloyd: product codes of whole-number vectors, with codebooks refined in exact rounds.

Components become floor(1024 * x); vectors are cut into `PARTS` consecutive parts, and each part position has a codebook of at most `ENTRIES` entries.
A round assigns every part to its nearest entry and replaces each entry by the componentwise floor of its parts' mean.

Vectors are packed into blocks. A block keeps, for each part position and entry, a heap of its parts there, keyed by slack:
the distance to the second nearest entry (lower bound) minus that to its own (upper bound) when it was scanned last, plus the drift that the entry
had gathered by then. An entry's drift grows in each round by how far it moved and how far any other moved at most. While a part's key
is above the drift of its entry, no other entry can be as near; so a round pops only the parts whose key is not, scans them against all entries
exactly, and pushes them again. A round sends the changes of sums and counts alone, as whole numbers, so totals are exact in any order.

Nothing but a codebook and its totals (ENTRIES times the components) is on the driver. Each round ends in a written table.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped; so are vectors with a component of 2**20 and more (their sums would not fit
a long), and those whose length isn't that of the least vec_id's vector with a length divisible by PARTS. Of equal ids the least vector comes first in the codebook;
rows without an id come last. Repeated rows are rows of their own. An error that does not fit a long is null. An empty table gives no rows. Only the three columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.packing import pack, tree_rounds, tree_sum, unpack
from strandmill.llm.shared import Tables, partitions_of

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 1 << 20
BLOCK = 4096
_MARGIN = 1e-9

STATE = "ids array<long>, labels array<string>, numbers binary, codes binary, keys binary, members binary, cuts binary, part long, blob binary"
CODED = "vec_id long, label string, code string, error long"


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all parts and entries, as whole numbers."""
    most = 2 * max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if parts.shape[1] * most * most < 1 << 53:  # all terms and sums are whole numbers that a double holds
        a, b = parts.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    kind = np.int64 if parts.shape[1] * most * most < 1 << 62 else object
    a, b = parts.astype(kind), entries.astype(kind)
    out = np.zeros((len(a), len(b)), kind)
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def scanned(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, ties to the lower one, and its slack: how much farther the second nearest is, a little less than that for safety."""
    far = squared(parts, entries)
    codes = far.argmin(axis=1)
    rows = np.arange(len(parts))
    upper = np.sqrt(far[rows, codes].astype(np.float64))
    if len(entries) == 1:
        return codes, np.full(len(parts), np.inf)
    far[rows, codes] = far.max() + 1 if len(far) else 0
    lower = np.sqrt(far.min(axis=1).astype(np.float64))
    return codes, lower - upper - _MARGIN * (lower + upper)


class Heaps:
    """The heaps of one part position of a block: keys and members of each entry's heap, one entry after the other."""

    def __init__(self, keys: np.ndarray, members: np.ndarray, cuts: np.ndarray):
        self.keys, self.members, self.cuts, self.opened = keys, members, cuts, {}

    @classmethod
    def of(cls, codes: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        """Sorted by key, which makes each a heap."""
        order = np.lexsort((keys, codes))
        return cls(keys[order], order.astype(np.int32), np.searchsorted(codes[order], np.arange(entries + 1)))

    def heap(self, entry: int) -> list[tuple[float, int]]:
        if entry not in self.opened:
            at = slice(self.cuts[entry], self.cuts[entry + 1])
            self.opened[entry] = list(zip(self.keys[at].tolist(), self.members[at].tolist(), strict=True))
        return self.opened[entry]

    def violated(self, drift: np.ndarray) -> list[int]:
        """Pops the parts whose key the drift of their entry has reached."""
        out = []
        filled = np.flatnonzero(self.cuts[1:] > self.cuts[:-1])
        for entry in filled[self.keys[self.cuts[filled]] <= drift[filled]].tolist():
            held, limit = self.heap(entry), drift[entry]
            while held and held[0][0] <= limit:
                out.append(heapq.heappop(held)[1])
        return out

    def push(self, members: list[int], codes: np.ndarray, keys: np.ndarray) -> None:
        for member, entry, key in zip(members, codes.tolist(), keys.tolist(), strict=True):
            heapq.heappush(self.heap(entry), (key, member))

    def closed(self) -> Heaps:
        """All heaps in arrays again."""
        if not self.opened:
            return self
        keys, members, sizes = [], [], np.diff(self.cuts)
        for entry in range(len(sizes)):
            at = slice(self.cuts[entry], self.cuts[entry + 1])
            if entry in self.opened:
                held = self.opened[entry]
                sizes[entry] = len(held)
                keys.append(np.array([k for k, _ in held], np.float64))
                members.append(np.array([m for _, m in held], np.int32))
            else:
                keys.append(self.keys[at])
                members.append(self.members[at])
        return Heaps(np.concatenate(keys), np.concatenate(members), np.concatenate([[0], np.cumsum(sizes)]))


def changes(numbers: np.ndarray, codes: np.ndarray, before: np.ndarray | None, moved: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What a round adds to sums and counts: keys ((position * ENTRIES + entry) * (width + 1) + component; the last component counts) and numbers."""
    width = numbers.shape[1] // PARTS
    total = np.zeros((PARTS, ENTRIES, width + 1), np.int64)
    for p in range(PARTS):
        rows = moved[p]
        own = np.concatenate([numbers[rows, p * width : (p + 1) * width].astype(np.int64), np.ones((len(rows), 1), np.int64)], axis=1)
        np.add.at(total[p], codes[rows, p], own)
        if before is not None:
            np.subtract.at(total[p], before[rows, p], own)
    keys = np.flatnonzero(total)
    return keys, total.ravel()[keys]


def advance(numbers: np.ndarray, codes: np.ndarray | None, heaps: list[Heaps] | None, books: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, list[Heaps], list[np.ndarray]]:
    """Codes and heaps of a block for new codebooks (position, entry, component), and the parts that changed their entry."""
    width, n, entries = books.shape[2], len(numbers), books.shape[1]
    parts = [numbers[:, p * width : (p + 1) * width] for p in range(PARTS)]
    if codes is None:
        found = [scanned(parts[p], books[p]) for p in range(PARTS)]
        codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
        return codes, [Heaps.of(c, slack + drift[p][c], entries) for p, (c, slack) in enumerate(found)], [np.arange(n)] * PARTS
    codes, moved = codes.copy(), []
    for p in range(PARTS):
        again = heaps[p].violated(drift[p])
        now, slack = scanned(parts[p][again], books[p])
        heaps[p].push(again, now, slack + drift[p][now])
        heaps[p] = heaps[p].closed()
        rows = np.array(again, np.int64)
        moved.append(rows[codes[rows, p] != now])
        codes[rows, p] = now
    return codes, heaps, moved


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors, as whole numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            numbers = np.floor(np.asarray(part.column(2).flatten()) * SCALE).astype(np.int32)
            yield _row(part.column(0).to_pylist(), part.column(1).to_pylist(), numbers, None, None, 0, None)


_STATE = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), *((c, pa.binary()) for c in ("numbers", "codes", "keys", "members", "cuts")), ("part", pa.int64()), ("blob", pa.binary())])


def _row(ids: list, labels: list, numbers: np.ndarray, codes: np.ndarray | None, heaps: list[Heaps] | None, task: int, blob: bytes | None) -> pa.RecordBatch:
    heaps = heaps or []
    one = lambda name, kind: b"".join(getattr(h, name).astype(kind).tobytes() for h in heaps)
    values = [ids, labels, numbers.tobytes(), codes.tobytes() if codes is not None else None, one("keys", np.float64), one("members", np.int32), one("cuts", np.int32), task, blob]
    return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, _STATE, strict=True)], schema=_STATE)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[list, list, np.ndarray, np.ndarray | None, list[Heaps] | None]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels, numbers, codes, keys, members, cuts = (batch.column(c)[k].as_py() for c in range(7))
            n = len(ids)
            numbers = np.frombuffer(numbers, np.int32).reshape(n, dim)
            if codes is None:
                yield ids, labels, numbers, None, None
                continue
            keys, members = np.frombuffer(keys, np.float64).reshape(PARTS, n), np.frombuffer(members, np.int32).reshape(PARTS, n)
            cuts = np.frombuffer(cuts, np.int32).reshape(PARTS, -1)
            yield ids, labels, numbers, np.frombuffer(codes, np.uint8).reshape(n, PARTS), [Heaps(*x) for x in zip(keys, members, cuts, strict=True)]


def _round(state: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    dim = books.shape[0] * books.shape[2]
    sent = state.sparkSession.sparkContext.broadcast((books, drift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for ids, labels, numbers, codes, heaps in _blocks(batches, dim):
            now, heaps, moved = advance(numbers, codes, heaps, *sent.value)
            yield _row(ids, labels, numbers, now, heaps, task.partitionId() if task else 0, pack(list(changes(numbers, now, codes, moved))))

    return state.mapInArrow(run, STATE)


def _coded(state: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The last assignment: each vector's code and its exact error."""
    width, dim = books.shape[2], books.shape[0] * books.shape[2]
    sent = state.sparkSession.sparkContext.broadcast((books, drift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value[0]
        for ids, labels, numbers, codes, heaps in _blocks(batches, dim):
            now = advance(numbers, codes, heaps, *sent.value)[0]
            apart = [numbers[:, p * width : (p + 1) * width].astype(np.int64) - books[p][now[:, p]] for p in range(PARTS)]
            most = max(int(np.abs(x).max(initial=0)) for x in apart)
            kind = np.int64 if dim * most * most < 1 << 62 else object
            error = sum((x.astype(kind) ** 2).sum(axis=1) for x in apart)
            shown = [bytes(c).hex() for c in now]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(shown), pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, CODED)


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector that is kept, and the codebooks: (position, entry, component)."""
    spark = vectors.sparkSession
    tables = Tables(spark, "codebooks")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = rows.where((F.size("vector") > 0) & (F.size("vector") % PARTS == 0)).orderBy(*order).select(F.size("vector").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], CODED), np.zeros((PARTS, 0, 0), np.int64)
    dim = first["n"]
    rows = rows.where(F.size("vector") == dim)
    start = np.floor(np.array([r["vector"] for r in rows.orderBy(*order).limit(ENTRIES).collect()]) * SCALE).astype(np.int64)
    books = start.reshape(len(start), PARTS, dim // PARTS).transpose(1, 0, 2).copy()
    drift = np.zeros(books.shape[:2])
    totals = np.zeros(PARTS * ENTRIES * (books.shape[2] + 1), np.int64)
    state = tables.put("vectors", rows.select("vec_id", "label", "vector").mapInArrow(_packed, STATE))
    depth = tree_rounds(max(partitions_of(spark), len(state.inputFiles())))
    for k in range(rounds):
        after = tables.put(f"round{k}", _round(state, books, drift))
        tables.free(state)
        state = after
        summed = tree_sum(state.select(F.lit(0).cast("long").alias("all"), "part", "blob"), {"all": pa.int64()}, depth).collect()
        keys, n = unpack(summed[0]["blob"])[0]  # one row, of all entries' components
        totals[keys] += n
        held = totals.reshape(PARTS, ENTRIES, -1)[:, : books.shape[1]]
        count = held[:, :, -1:]
        now = np.where(count > 0, held[:, :, :-1] // np.maximum(count, 1), books)
        moved = np.sqrt(((now - books).astype(np.float64) ** 2).sum(axis=2))
        top = np.sort(moved, axis=1)[:, ::-1]
        others = np.where(moved == top[:, :1], top[:, 1:2] if books.shape[1] > 1 else 0.0, top[:, :1])
        others = np.where((moved == top[:, :1]).sum(axis=1, keepdims=True) > 1, top[:, :1], others)
        drift = drift + (moved + others) * (1 + _MARGIN)
        books = now
    return _coded(state, books, drift), books


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = Tables(spark, "codes").put("coded", coded)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    held = coded.alias("c").join(by_label.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")), "left")
    return held.select("c.vec_id", "c.code", "c.error", "s.label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other, by all distances."""
    near = "list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, c.v) + list_inner_product(c.v, c.v)"
    steps = [f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, p, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS v FROM kept, range({PARTS}) AS r(p)
), c0 AS (
  SELECT p, k, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < {ENTRIES}
)"""]  # fmt: skip
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(v) AS v, CAST(min(d * {ENTRIES} + k) AS BIGINT) AS dk FROM (SELECT q.*, c.k, {near} AS d FROM parts q JOIN c{r} c ON c.p = q.p) GROUP BY vec_id, label, p
)""")  # fmt: skip
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.p, c.k, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT p, k, list(m ORDER BY i) AS v FROM (
      SELECT p, k, i, floor(sum(x) / count(*)) AS m FROM (SELECT p, dk % {ENTRIES} AS k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY p, k, i) GROUP BY p, k
  ) n ON n.p = c.p AND n.k = c.k
)""")  # fmt: skip
    return ", ".join(steps) + f""", coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', dk % {ENTRIES})), '' ORDER BY p) AS code, CAST(sum(dk // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label
), digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, k)) AS h FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, digest"""


OP13_SQL = _sql()
