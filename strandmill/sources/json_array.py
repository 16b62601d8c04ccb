"""Elements of files that are one large JSON array, read by many tasks.

Spark cuts a file into blocks behind closing braces. Whether a block starts inside a string, and how deep, depends on all before it; so a first pass
notes for each block what it does to either state (`Effect`), the driver runs through these, one small row for each block, and the second pass
cuts each block into elements. An element that goes over several blocks is put together by its number.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = re.compile(rb'\\.|["{}\[\]]', re.S)
_OPEN, _CLOSE = b"{[", b"}]"
_TOGETHER = 1 << 20  # bytes of elements that are sent at once, or one longer element


@dataclass
class Effect:
    """What a stretch of text does from a known state: whether it ends inside a string, by how much the depth changes, and how many objects open at each relative depth."""

    inside: bool
    depth: int = 0
    opened: Counter = field(default_factory=Counter)
    first: str = ""  # the first bracket outside of strings

    def bracket(self, mark: bytes) -> None:
        """A bracket outside of strings."""
        self.first = self.first or mark.decode()
        if mark in _OPEN:
            if mark == b"{":
                self.opened[self.depth] += 1
            self.depth += 1
        else:
            self.depth -= 1


def read_both(out: Effect, within: Effect, text: bytes) -> None:
    """A piece read from either state. A quote changes both, so one of the two is inside a string and the other is not: each mark is looked at once."""
    for m in _MARK.finditer(text):
        mark = m[0]
        if mark == b'"':
            out.inside, within.inside = within.inside, out.inside
        elif len(mark) == 1:
            (within if out.inside else out).bracket(mark)


def cut(pieces: Iterator[bytes], inside: bool, depth: int, base: int) -> Iterator[tuple[int, bool, bytes]]:
    """(how many elements have begun in the block, whether this one is whole, its text) of all elements that are in a block or reach into it."""
    number, held, began = 0, [], False
    running = depth > base or inside
    for text in pieces:
        start = 0 if running else None
        for m in _MARK.finditer(text):
            mark = m[0]
            if mark == b'"':
                inside = not inside
            elif not inside and len(mark) == 1:
                if mark in _OPEN:
                    if depth == base and mark == b"{":
                        number, began, running, start, held = number + 1, True, True, m.start(), []
                    depth += 1
                else:
                    depth -= 1
                    if depth == base and running and mark == b"}":
                        held.append(text[start : m.end()])
                        yield number, began, b"".join(held)
                        running, start, held = False, None, []
        if running:
            held.append(text[start:])
    if running and held:
        yield number, False, b"".join(held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """The pieces of each block, each with the brace that it ends with. A task's blocks come one after the other."""
    rows = ((path, block, piece) for b in batches for path, block, piece in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        path, block = ahead[:2]

        def own(path: str = path, block: int = block) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[:2] == (path, block):
                yield ahead[2].encode() + b"}"
                ahead = next(rows, None)

        yield path, block, own()


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, block, pieces in _blocks(batches):
        both = [Effect(False), Effect(True)]
        for piece in pieces:
            read_both(*both, piece)
        told = json.dumps([[x.inside, x.depth, list(x.opened.items()), x.first] for x in both])
        yield pa.record_batch([pa.array([path]), pa.array([block], pa.int64()), pa.array([told])], names=["path", "block", "told"])


def elements(spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(pos, text) of every object in the arrays of the files of a path, numbered from 0 in the order of the files' names and their places there. A file may be one object, too, or several one after the other.
    A file that ends inside an element is an error; an empty one has none. keep(rows) may write the cut elements and read them again: without it each use of the result cuts the files twice."""
    read = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    starts: dict[str, dict[int, tuple[bool, int, int, int]]] = {}
    number, file, inside, depth, base = 0, None, False, 0, 1
    for row in sorted(read.mapInArrow(_effects, "path string, block long, told string").collect()):  # one row for each block
        if row["path"] != file:
            _ended(file, inside, depth)
            file, inside, depth, base = row["path"], False, 0, -1
        after, change, opened, first = json.loads(row["told"])[int(inside)]
        if base < 0 and first:
            base = 1 if first == "[" else 0
        starts.setdefault(file, {})[row["block"]] = (inside, depth, max(base, 0), number)
        number += dict(map(tuple, opened)).get(max(base, 0) - depth, 0)
        inside, depth = after, depth + change
    _ended(file, inside, depth)
    sent = spark.sparkContext.broadcast(starts)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, pieces in _blocks(batches):
            inside, depth, base, before = sent.value[file][block]
            rows, size = [], 0
            for k, whole, text in cut(pieces, inside, depth, base):
                # A part stands in a column of its own: whatever looks into texts, in whatever order of filters, finds whole ones.
                rows.append((before + k - 1, block, *((text.decode(), None) if whole else (None, text.decode()))))
                size += len(text)
                if size >= _TOGETHER:
                    yield sent_rows(rows)
                    rows, size = [], 0
            if rows:
                yield sent_rows(rows)

    def sent_rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["pos", "block", "text", "part"])

    found = read.mapInArrow(cuts, "pos long, block long, text string, part string")
    found = keep(found) if keep is not None else found
    parts = found.where("part IS NOT NULL").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("p"))
    return found.where("text IS NOT NULL").select("pos", "text").unionByName(parts.select("pos", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text")))


def _ended(file: str | None, inside: bool, depth: int) -> None:
    # Behind the last piece stands a brace that the file does not have.
    if file is not None and (inside or depth not in (0, -1)):
        raise ValueError(f"{file} ends inside of its array")
