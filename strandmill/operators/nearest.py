"""Vector search in blocks: every query against every vector, as products of matrices, without a row for each pair.

Queries are taken in blocks of bounded size, one block at a time on all tasks; each block is one pass over the vectors. A task keeps
the first k of each query over what it has seen and returns only these, and the partial firsts are ranked together. Exact: all pairs are
scored in double precision, scores are rounded as all scores are, and ties go by the given order.

A vector of length 0 scores 0. A vector that is null, of another length than the query, or holds a null or a number that isn't finite scores null, which comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the queries' vectors in a block: of the driver, and of each worker.
BLOCK_BYTES = 32 << 20
_ROWS, _QUERIES = 1024, 2048


def units(rows: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Matrices of unit vectors by length, each with the rows that it has; and the rows that can't be scored."""
    by: dict[int, list[int]] = {}
    bad = []
    for k, v in enumerate(rows):
        if v is None or any(x is None for x in v) or not np.isfinite(np.array(v, np.float64)).all():
            bad.append(k)
        else:
            by.setdefault(len(v), []).append(k)
    out = []
    for at in by.values():
        m = np.array([rows[k] for k in at], np.float64).reshape(len(at), -1)
        n = np.sqrt((m * m).sum(axis=1))
        out.append((np.array(at, np.int64), m, np.where(n == 0, 1.0, n)))
    return out, np.array(bad, np.int64)


def scores(queries: tuple, records: tuple, n: int, m: int) -> np.ndarray:
    """(query, record) rounded cosines; NaN where there is none."""
    out = np.full((n, m), np.nan)
    for own, a, la in queries[0]:
        for at, b, lb in records[0]:
            if a.shape[1] == b.shape[1]:
                out[np.ix_(own, at)] = np.round((a @ b.T) / (la[:, None] * lb[None, :]), 9)
    return out


class First:
    """The first k records of each query so far, by score and order; with `some`, records without a score don't count."""

    def __init__(self, k: int | None, descending: bool, some: bool = False):
        self.k, self.ties, self.held, self.some = k, "descending" if descending else "ascending", None, some
        self.least = None  # of each query the score that a record has to reach

    def add(self, found: np.ndarray, order: pa.Array, ids: pa.Array) -> None:
        n, k = found.shape[0], self.k
        found = np.where(np.isnan(found), -np.inf, found)
        if self.least is None:
            self.least = np.full(n, -np.inf)
        enough = self.least
        if k is not None and found.shape[1] > k:
            enough = np.maximum(enough, np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k])
        kept = found >= enough[:, None]
        q, r = np.nonzero(kept & (found > -np.inf) if self.some else kept)
        new = pa.table([pa.array(q), pa.array(found[q, r]), order.take(pa.array(r)), ids.take(pa.array(r))], names=["q", "score", "order", "id"])
        if k is None:
            self.held = new if self.held is None else pa.concat_tables([self.held, new])
            return
        both = new if self.held is None else pa.concat_tables([self.held, new])
        both = both.sort_by([("q", "ascending"), ("score", "descending"), ("order", self.ties)])
        own = np.asarray(both.column("q"))
        start = np.searchsorted(own, np.arange(n))
        both = both.filter(pa.array(np.arange(len(own)) - start[own] < k))
        self.held = both
        own, score = np.asarray(both.column("q")), np.asarray(both.column("score"))
        count = np.bincount(own, minlength=n)
        last = np.full(n, -np.inf)
        last[own] = score  # the last row of each query is its least
        self.least = np.where(count == k, last, -np.inf)


def nearest(queries: DataFrame, records: DataFrame, k: int | None, *, order: str = "record_id", descending_ties: bool = False, weight: float = 1.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """question_id, record_id, (order,) score of the first k of each query in every part of the records: partial firsts, which hold the first of all.

    queries: question_id, query_vector; records: record_id, vector, and `order` if it is another column. weight: the records are ranked by the rounded product of it and the score.
    k=None gives all pairs."""
    spark, names = queries.sparkSession, list(dict.fromkeys(["record_id", order]))
    wide = queries.select("question_id", F.col("query_vector").cast("array<double>").alias("v"))
    size = wide.agg(F.sum(F.coalesce(F.size("v"), F.lit(0)) * 8 + 64).alias("b")).first()["b"] or 0
    count = max(1, -(-size // block_bytes))
    held = records.select(*names, F.col("vector").cast("array<double>").alias("vector"))
    schema = ", ".join([f"question_id {dict(queries.dtypes)['question_id']}", *(f"{c} {dict(records.dtypes)[c]}" for c in names), "score double"])
    out = None
    for block in range(count):
        some = wide if count == 1 else wide.where(F.pmod(F.xxhash64("question_id"), F.lit(count)) == block)
        part = _block(spark.sparkContext.broadcast(_taken(some.toArrow())), held, k, order, descending_ties, weight, schema, names)
        out = part if out is None else out.unionByName(part)
    return out


def _taken(table: pa.Table) -> list[tuple]:
    """Queries in groups whose products with a batch of vectors are of bounded size: ids, matrices."""
    out = []
    for at in range(0, table.num_rows, _QUERIES):
        rows = table.slice(at, _QUERIES)
        out.append((rows.column(0).combine_chunks(), units(rows.column(1).to_pylist())))
    return out


def _block(sent: Broadcast, records: DataFrame, k: int | None, order: str, descending: bool, weight: float, schema: str, names: list[str]) -> DataFrame:
    def rows(ids: pa.Array, first: First) -> pa.RecordBatch:
        found = first.held
        score = np.asarray(found.column("score"))
        # The weighted score ranks; the cosine itself is given back.
        values = [ids.take(found.column("q").combine_chunks()), found.column("id").combine_chunks(), *([found.column("order").combine_chunks()] if len(names) > 1 else []), pa.array(score, mask=np.isinf(score))]
        return pa.record_batch(values, names=["question_id", *names, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [First(k, descending) for _ in sent.value]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                vectors, ids = units(part.column(len(names)).to_pylist()), part.column(0)
                tie = part.column(names.index(order))
                for (own, held), first in zip(sent.value, firsts, strict=True):
                    found = scores(held, vectors, len(own), part.num_rows)
                    first.add(found if weight == 1.0 else np.round(weight * found, 9), tie, ids)
                    if k is None:
                        yield rows(own, first)
                        first.held = None
        if k is not None:
            yield from (rows(own, first) for (own, _), first in zip(sent.value, firsts, strict=True) if first.held is not None)

    return records.mapInArrow(run, schema)
