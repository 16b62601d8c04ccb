"""Texts of an Arrow batch as NumPy arrays: bytes, words, and hashes of words and windows.

All operators that work in Python read their texts through `slices`, which hands out
at most `max_bytes` of text at a time (a longer single text comes alone), so memory
does not depend on how many rows an Arrow batch holds. A null text is an empty text here;
`Slice.valid` still tells them apart.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # not glibc: nothing to trim
    _libc = None

U64 = np.uint64
SLICE_BYTES = 2 << 20
#: Sums modulo 2**64 are equal for some different strings from a few hundred bytes on, whatever the base; longer words are hashed otherwise.
LONG_WORD = 64

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_BLOCK_BITS = 16
_BLOCK = 1 << _BLOCK_BITS


def _low_powers(base: np.uint64) -> np.ndarray:
    out = np.full(_BLOCK, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers modulo 2**64 of the base and of its inverse: of the places in a block, and of the blocks (grown as needed).
_LOW = {"up": _low_powers(_BASE), "down": _low_powers(_INVERSE)}
_high = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _block_powers(kind: str, blocks: int) -> np.ndarray:
    if len(_high[kind]) < blocks:
        out = np.full(blocks * 5 // 4 + 16, pow(int(_BASE if kind == "up" else _INVERSE), _BLOCK, 2**64), np.uint64)
        out[0] = 1
        _high[kind] = np.multiply.accumulate(out)
    return _high[kind]


def _times_powers(kind: str, values: np.ndarray) -> None:
    """Multiplies the values by the powers of their places."""
    low, high = _LOW[kind], _block_powers(kind, len(values) // _BLOCK + 1)
    for k, at in enumerate(range(0, len(values), _BLOCK)):
        part = values[at : at + _BLOCK]
        part *= low[: len(part)] * high[k]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def trim() -> None:
    """Gives memory that arrays have left back to the system; a worker that waits then holds little."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which `span_hash` takes the hash of any span. Bytes stand for their codes."""
    out = np.zeros(len(codes) + 1, np.uint64)
    if codes.dtype == np.uint8:
        for at in range(0, len(codes), _BLOCK):
            out[1 + at : 1 + at + _BLOCK] = BYTE_CODE[codes[at : at + _BLOCK]]
    else:
        out[1:] = codes
    _times_powers("up", out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal spans get equal values wherever they stand; their length is mixed in. Different long spans may be built to get equal values
    too (`LONG_WORD`): callers compare the bytes, or take other hashes for these."""
    high = _block_powers("down", len(prefix) // _BLOCK + 1)
    out = prefix[end] - prefix[start]
    out *= _LOW["down"][start & (_BLOCK - 1)]
    out *= high[start >> _BLOCK_BITS]
    out += (end - start).astype(np.uint64) * U64(0xA0761D6478BD642F)
    return mix(out)


def window_hash(prefix: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of one length; equal to span_hash of the same spans."""
    n = len(prefix) - length
    if n <= 0:
        return np.empty(0, np.uint64)
    out = prefix[length:] - prefix[:n]
    _times_powers("down", out)
    out += U64(length * 0xA0761D6478BD642F % 2**64)
    return mix(out)


@dataclass
class Slice:
    """Some rows of a batch: `offsets` cuts `data` into their texts."""

    rows: pa.RecordBatch
    offsets: np.ndarray
    data: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets (from 0), bytes and validity of a string column, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(len(column), bool)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.empty(0, np.uint8), valid
    cuts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return cuts - cuts[0], whole[cuts[0] : cuts[-1]], valid


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, data, valid = text_arrays(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            cut = offsets[at : end + 1]
            yield Slice(batch.slice(at, end - at), cut - cut[0], data[cut[0] : cut[-1]], valid[at:end])
            at = end


def table_of(ranges: Iterable[tuple[int, int]]) -> np.ndarray:
    """A look-up of 256 flags: False inside the given closed byte ranges."""
    out = np.ones(256, bool)
    for low, high in ranges:
        out[low : high + 1] = False
    return out


#: Words [^\x20\x09-\x0D]+ and, after A-Z is lower-cased, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACED = table_of([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = table_of([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """Words of a slice: byte spans, and `cuts`, which cuts the words into texts."""

    start: np.ndarray
    end: np.ndarray
    cuts: np.ndarray
    hashes: np.ndarray | None

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True) -> Words:
    """`data` is already lower-cased where that is asked for. Words never cross texts."""
    n = len(data)
    inside = table[data]
    edge = inside.copy()  # first byte of a word
    edge[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    edge[first] = inside[first]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    final = offsets[1:][np.diff(offsets) > 0] - 1
    last[final] = inside[final]
    start, end = np.flatnonzero(edge), np.flatnonzero(last) + 1
    hashes = span_hash(prefix_hash(data), start, end) if hashed and n else np.empty(0, np.uint64)
    if hashed and n:
        for k in np.flatnonzero(end - start > LONG_WORD).tolist():
            hashes[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return Words(start, end, np.searchsorted(start, offsets), hashes)


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, most: int = SLICE_BYTES) -> np.ndarray:
    """Whether the bytes of each two spans of one length are the same; at most about `most` bytes are held against each other at a time."""
    out = np.ones(len(a), bool)
    ends, at = np.cumsum(length), 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - length[at] + most, "right")))
        n = length[at:stop]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = data[np.repeat(a[at:stop], n) + step] != data[np.repeat(b[at:stop], n) + step]
        out[at + np.repeat(np.arange(stop - at), n)[other]] = False
        at = stop
    return out


def windows_of(words: Words, length: int, short_whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `length` words that lie in one text, and the first word of each.

    With short_whole a text of fewer words, but not none, has one window: all its words."""
    counts = np.diff(words.cuts)
    prefix = prefix_hash(words.hashes)
    owner = words.owner()
    at = np.arange(len(owner))
    full = at + length <= words.cuts[1:][owner] if len(owner) else np.empty(0, bool)
    starts = at[full]
    hashes = window_hash(prefix, length)[starts] if len(starts) else np.empty(0, np.uint64)
    if short_whole and (few := (counts > 0) & (counts < length)).any():
        s, e = words.cuts[:-1][few], words.cuts[1:][few]
        starts, hashes = np.concatenate([starts, s]), np.concatenate([hashes, span_hash(prefix, s, e)])
        order = np.argsort(starts, kind="stable")
        starts, hashes = starts[order], hashes[order]
    return hashes, starts


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the n places that lie in any span [start, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:n]) > 0


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]
