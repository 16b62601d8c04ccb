"""Rows of numbers packed into blobs, one blob for each bucket of a slice: shuffles move few, large rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket long, blob binary"
FAN = 64
_KINDS = [(k, np.iinfo(k).min, np.iinfo(k).max) for k in (np.int8, np.int16, np.int32)]
_SQUEEZE, _OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(columns: list[np.ndarray], data: np.ndarray | None = None) -> bytes:
    """Columns of whole numbers, each as differences, and bytes."""
    parts = [np.array([len(columns), len(columns[0])], np.int64).tobytes()]
    for c in columns:
        step = np.diff(c, prepend=c.dtype.type(0))
        low, high = (int(step.min()), int(step.max())) if len(step) else (0, 0)
        kind = next((k for k, least, most in _KINDS if least <= low and high <= most), np.int64)
        parts += [np.array([np.dtype(kind).itemsize], np.int64).tobytes(), step.astype(kind).tobytes()]
    if data is not None:
        parts.append(data.tobytes())
    return _SQUEEZE.compress(b"".join(parts))


def unpack(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    raw = _OPEN.decompress(blob)
    count, n = np.frombuffer(raw, np.int64, 2)
    at, columns = 16, []
    for _ in range(count):
        width = int(np.frombuffer(raw, np.int64, 1, at)[0])
        columns.append(np.cumsum(np.frombuffer(raw, f"i{width}", n, at + 8), dtype=np.int64))
        at += 8 + width * int(n)
    return columns, np.frombuffer(raw, np.uint8, offset=at)


def unpack_all(blobs: list[bytes], width: int) -> list[np.ndarray]:
    """The columns of all blobs, one after the other."""
    parts = [unpack(b)[0] for b in blobs]
    return [np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)]) for k in range(width)]


def cut_up(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by key, and (key, low, high) of each key's part of it."""
    order = np.argsort(keys, kind="stable")
    if not len(keys):
        return order, []
    ordered = keys[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, list(zip(ordered[at].tolist(), at.tolist(), np.append(at[1:], len(keys)).tolist(), strict=True))


def emit(found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(found), 512):
        some = found[k : k + 512]
        yield pa.record_batch([pa.array([x for x, _ in some], pa.int64()), pa.array([b for _, b in some], pa.binary())], names=["bucket", "blob"])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and the sum of each one's numbers."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    if not len(keys):
        return keys, n
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n, at)


def tree_rounds(partitions: int) -> int:
    """Rounds in which the parts of so many tasks become one, `FAN` at a time."""
    rounds = 1
    while partitions > FAN:
        partitions, rounds = -(-partitions // FAN), rounds + 1
    return rounds


def tree_sum(frame: DataFrame, keys: dict[str, pa.DataType], rounds: int) -> DataFrame:
    """The sum of packed counts (blobs of keys and numbers) for each group. frame: the keys, part (the task), blob.

    A task sums at most `FAN` parts at a time (the last round takes what is left), so it holds no more than
    `FAN` times the distinct counts of a group, however many tasks have counted."""
    names = list(keys)

    def total(key: tuple, table: pa.Table) -> pa.Table:
        counts = summed(*unpack_all(table.column("blob").to_pylist(), 2))
        columns = [pa.array([x.as_py()], kind) for x, kind in zip(key, [*keys.values(), pa.int64()], strict=False)]
        return pa.table([*columns, pa.array([pack(list(counts))], pa.binary())], names=[*names, "part", "blob"])

    for k in range(rounds):
        part = F.floor(F.col("part") / FAN).cast("long") if k < rounds - 1 else F.lit(0).cast("long")
        frame = frame.withColumn("part", part)
        frame = frame.groupBy(*names, "part").applyInArrow(total, frame.select(*names, "part", "blob").schema)
    return frame.select(*names, "blob")
