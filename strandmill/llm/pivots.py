"""Near duplicates of vectors by a pivot-permutation index.

A vector is described by its `NEAR` nearest reference points (pivots) in order. Pivots are rows of a bounded sample, each the farthest from those
taken before, so a dense family of vectors gets few of them. Two vectors are candidates if they share at least `SHARED` of their
nearest pivots; candidates are verified by their cosine in double precision.

Retrieval goes through inverted lists of pivots. With the pivots of a description in one global order (rare ones of the sample
first), a pair that shares `SHARED` of `NEAR` has its first shared pivot among the first NEAR - SHARED + 1 of both, so only these
are posted. A list of more than `LIST` members is divided by the next shared pivot, down to `SHARED` pivots; what is still
longer is held together in pairs of bounded blocks. Each pair is verified in one list: that of its first shared pivots. A task
counts shared pivots and cosines of two blocks as matrices and returns counts and a spanning forest, never pairs.

Equal vectors of one label are one class: only one of them is described, and the others get its links.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with nothing
(n_links 0, component_id their own id). Vectors of different lengths are not compared. Repeated ids are vectors of their own; a row without an id keeps
its links, and is never the least id. An empty table gives no rows. Only the three columns are read.

Recall: not guaranteed by the method; measured against brute force in tests/llm and in the README. With few classes (at most 4 * NEAR) there are only
NEAR pivots, so every pair is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.shared import Tables, components

THRESHOLD = 0.98
PIVOTS = 512
NEAR = 8
SHARED = 3
SAMPLE = 4096
LIST = 1024
_ROWS = 2048

DESCRIBED = "cid long, label string, dim int, size long, unit binary, near array<int>"
FOUND = "cid long, other long, n long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; first divided by their largest component, so that nothing overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    """Cut or filled with zeros to a number of components."""
    return vectors[:, :width] if vectors.shape[1] >= width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def choose(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots from unit vectors, each the farthest from those before, in the order of how few of the sample have them near."""
    closest = np.full(len(sample), -2.0)
    taken: list[int] = []
    for _ in range(min(count, len(sample))):
        taken.append(int(np.argmin(closest)))
        closest = np.maximum(closest, sample @ sample[taken[-1]])
        closest[taken[-1]] = 2.0
    pivots = sample[taken]
    often = np.bincount(nearest(sample, pivots).ravel(), minlength=len(pivots))
    return pivots[np.argsort(often, kind="stable")]


def nearest(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, the nearest first, ties to the earlier pivot."""
    out = np.empty((len(units), min(NEAR, len(pivots))), np.int32)
    for at in range(0, len(units), _ROWS):
        far = -(units[at : at + _ROWS] @ pivots.T)
        out[at : at + _ROWS] = np.argsort(far, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def joined_units(units: np.ndarray, near: np.ndarray, sizes: np.ndarray, path: list[int], split: int | None, shared: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one list: their sum of sizes for each member, and the least member that each is tied to.

    With split, only members before it are held against those from it on."""
    n = len(units)
    pivots, place = np.unique(near, return_inverse=True)
    held = np.zeros((n, len(pivots)), np.float32)
    held[np.arange(n)[:, None], place.reshape(near.shape)] = 1
    low = held[:, pivots <= path[-1]]
    rows, columns = (slice(0, n), slice(0, n)) if split is None else (slice(0, split), slice(split, n))
    linked = (held[rows] @ held[columns].T >= shared) & (low[rows] @ low[columns].T == len(path)) & (units[rows] @ units[columns].T >= threshold)
    if split is None:
        np.fill_diagonal(linked, False)
        total = linked @ sizes
    else:
        total = np.concatenate([linked @ sizes[columns], linked.T @ sizes[rows]])
    label = np.arange(n)
    while linked.any():
        before = label.copy()
        first = np.where(linked, label[columns][None, :], n).min(axis=1)
        label[rows] = np.minimum(label[rows], first)
        second = np.where(linked, label[rows][:, None], n).min(axis=0)
        label[columns] = np.minimum(label[columns], second)
        label = label[label]
        if np.array_equal(before, label):
            break
    return total, label


def described(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each class with its unit vector and its nearest pivots in the global order."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                lists = part.column(3)
                dims = np.asarray(lists.value_lengths()).astype(np.int64)
                flat, starts = np.asarray(lists.flatten()), np.cumsum(dims) - dims
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    units = unit(flat[starts[rows][:, None] + np.arange(dim)])
                    near = np.sort(nearest(fitted(units, sent.value.shape[1]), sent.value), axis=1)
                    own = part.take(pa.array(rows))
                    yield pa.record_batch(
                        [own.column(0), own.column(1), pa.array(dims[rows], pa.int32()), own.column(2), pa.array([u.tobytes() for u in units], pa.binary()), pa.array(list(near), pa.list_(pa.int32()))],
                        names=["cid", "label", "dim", "size", "unit", "near"],
                    )

    return classes.select("cid", "label", "size", "vector").mapInArrow(run, DESCRIBED)


def _lists(tables: Tables, index: DataFrame, shared: int, limit: int) -> DataFrame:
    """(cid, label, dim, path, blocks): in which lists each class is, and in how many blocks a list is."""
    key = ["label", "dim", "path"]
    size = F.size("near")
    at = index.select("cid", "label", "dim", "near", F.posexplode(F.slice(F.col("near"), F.lit(1), F.greatest(size - shared + 1, F.lit(1)))).alias("place", "p")).select("cid", "label", "dim", "near", "place", F.array("p").alias("path"))
    done: DataFrame | None = None
    for depth in range(1, shared + 1):
        at = tables.put("postings", at)
        counted = at.groupBy(*key).agg(F.count("*").alias("n"))
        long = tables.put("long", counted.where(F.col("n") > limit).withColumn("blocks", F.ceil(F.col("n") / limit).cast("int")).drop("n"))
        if long.isEmpty():
            rest = at.withColumn("blocks", F.lit(1))
            at = None
        elif depth == shared:
            rest = at.join(long, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            at = None
        else:
            rest = at.join(long, key, "left_anti").withColumn("blocks", F.lit(1))
            further = at.join(long.drop("blocks"), key, "left_semi")
            # The next shared pivot stands behind this one, and has shared - depth - 1 more behind it.
            last = F.size("near") - shared + depth + 1
            ahead = F.filter(F.transform(F.col("near"), lambda p, i: F.struct(i.alias("place"), p.alias("p"))), lambda x: (x["place"] > F.col("place")) & (x["place"] < last))
            at = further.select("cid", "label", "dim", "near", "path", F.explode(ahead).alias("x")).select("cid", "label", "dim", "near", F.col("x.place").alias("place"), F.array_append("path", F.col("x.p")).alias("path"))
        rest = rest.select("cid", *key, "blocks")
        done = rest if done is None else done.unionByName(rest)
        if at is None:
            break
    return done


def _links(tables: Tables, index: DataFrame, shared: int, limit: int, threshold: float) -> DataFrame:
    """For each class and list: the sum of the sizes of classes linked with it, and a class that it is tied to."""
    posted = _lists(tables, index, shared, limit).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # A member of a list in blocks meets every block once: it goes to each pair of its own block and another.
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y"))))
    dealt = posted.withColumn("pair", pairs).select("cid", "label", "dim", "path", "pair.x", "pair.y", "block")
    full = dealt.join(index.select("cid", "size", "unit", "near"), "cid").repartition("label", "dim", "path", "x", "y")

    def hold(key: tuple, table: pa.Table) -> pa.Table:
        nothing = pa.table([pa.array([], pa.int64())] * 3, names=["cid", "other", "n"])
        if table.num_rows < 2:
            return nothing
        path, x, y = key[2].as_py(), key[3].as_py(), key[4].as_py()
        table = table.sort_by([("block", "ascending"), ("cid", "ascending")])
        cids, sizes = np.asarray(table.column("cid")), np.asarray(table.column("size"))
        units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(cids), -1)
        near = np.array(table.column("near").to_pylist(), np.int32)
        split = None if x == y else int(np.searchsorted(np.asarray(table.column("block")), y))
        total, label = joined_units(units, near, sizes, path, split, shared, threshold)
        some = np.flatnonzero(total > 0)
        return pa.table([pa.array(cids[some]), pa.array(cids[label[some]]), pa.array(total[some].astype(np.int64))], names=["cid", "other", "n"])

    return full.groupBy("label", "dim", "path", "x", "y").applyInArrow(hold, FOUND)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, pivots: int = PIVOTS, shared: int = SHARED, limit: int = LIST) -> DataFrame:
    """One row for each vector: vec_id, n_links (other vectors with a cosine of the threshold and more that were found), component_id (the least id
    that links lead to) and kept (whether it is the vector's own)."""
    spark = vectors.sparkSession
    tables = Tables(spark, "pivots")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole: Column = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & whole & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    counted = rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = tables.put("classes", counted.withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    sample = [np.array(r["vector"])[None] for r in classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()]
    width = max((v.shape[1] for v in sample), default=1)
    points = choose(np.concatenate([fitted(unit(v), width) for v in sample]), min(pivots, max(NEAR, n // 4))) if sample else np.zeros((1, 1))
    index = tables.put("described", described(classes, points))
    found = tables.put("found", _links(tables, index, min(shared, NEAR, len(points)), limit, threshold))
    linked = found.groupBy("cid").agg(F.sum("n").alias("n"))
    tied = components(tables, found.select(F.col("cid").alias("u"), F.col("other").alias("v")))
    named = classes.select("cid", "least").join(tied.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least", F.coalesce("label", "cid").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    result = named.join(roots, "root").join(linked, "cid", "left").select("cid", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    result = classes.join(result, "cid").select("label", "vector", "component_id", (F.col("n") + F.col("size") - 1).alias("n_links"))
    out = rows.join(result, ["label", "vector"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op11_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), p AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.u, p.v FROM reach r JOIN p ON r.v = p.u
), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""
