"""Byte-level BPE encoding and decoding, with tree concatenation for long unsplit text.

`ByteBPE` reads a tokenizer file of the byte-level BPE kind and gives the ids that the tokenizers
library gives for it. The pattern splits a text into pieces and the merges work inside a piece. A piece of more
than `LEAF` bytes (a text without a place to split) is cut in halves down to leaves, which are encoded in
parallel; each join then re-encodes a window around the cut, which doubles until its first token is the left side's and its last
token is the right side's, or until it holds both sides. Two neighbouring tokens stand together in an
encoding exactly when they do so alone, so agreement at both ends of the window makes the
joined sequence the encoding of the whole.

Where a text splits depends on the classes of its characters, which may differ between versions of Unicode. Texts with such characters are split by
the tokenizers library; their long pieces go through the tree like all others, and those without a long piece are encoded there at once. Files whose ids don't
follow the order of their merges are left to the library.

Defined results: null and empty texts have no ids and decode to an empty text; special tokens in a
text become their ids, as in the library; repeated rows are encoded alike; an empty table gives no rows. Only the
id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.textarrays import SPACED, Slice, slices, words_of

#: The split pattern of this kind of tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 1 << 12
WINDOW_TOKENS = 8
#: Letters and marks whose class is the same in every version of Unicode in use.
_SETTLED = re.compile("[^\x00-ȳΑ-ΡΣ-ωА-я‐-‧‰-⁞€、-〃ぁ-ゖァ-ヺ一-龥]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str, leaf: int = LEAF):
        import regex
        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.leaf, self.library = leaf, tokenizers.Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        first = len(vocab) - len(merges)
        self.in_order = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and first == 256 and all(spec["model"]["vocab"].get(a + b) == first + k for k, (a, b) in enumerate(merges)) and all(x["special"] and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in spec["added_tokens"])
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}) if self.in_order else None
        self.pieces = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.by_id = [b""] * size
        for token, i in vocab.items():
            self.by_id[i] = token
        for token, i in self.special.items():
            self.by_id[i] = token.encode()
        self.lengths = np.array([len(x) for x in self.by_id], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.by_id), np.uint8)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Both sides are encodings of neighbouring parts of one piece."""
        width = WINDOW_TOKENS
        while True:
            i, j = min(width, len(left)), min(width, len(right))
            window = self.core._encode_single_piece(b"".join(self.by_id[t] for t in [*left[len(left) - i :], *right[:j]]))
            from_left = i == len(left) or window[0] == left[len(left) - i]
            to_right = j == len(right) or window[-1] == right[j - 1]
            if from_left and to_right and (len(window) > 1 or i == len(left) and j == len(right)):
                return left[: len(left) - i] + window + right[j:]
            width *= 2

    def tree(self, piece: bytes, pool: ThreadPoolExecutor | None = None) -> list[int]:
        """A piece of any length; the leaves are encoded in parallel, then joined in pairs, level by level."""
        if len(piece) <= self.leaf:
            return self.core._encode_single_piece(piece)
        count = 1
        while len(piece) / count > self.leaf:
            count *= 2
        cuts = [len(piece) * k // count for k in range(count + 1)]
        leaves = [piece[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        level = list((pool.map if pool else map)(self.core._encode_single_piece, leaves))
        while len(level) > 1:
            level = list((pool.map if pool else map)(self.join, level[::2], level[1::2]))
        return level[0]

    def split(self, text: str, wide: bool) -> Iterator[str]:
        """The pieces of a text without special tokens; wide: by the library."""
        if wide:
            return (text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text))
        return (m[0] for m in self.pieces.finditer(text))

    def plain(self, text: str, unsplit: bool, wide: bool = False, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
        """A text without special tokens."""
        if not unsplit:
            return self.core.encode_to_numpy(text, disallowed_special=())
        ids: list[int] = []
        for piece in self.split(text, wide):
            ids += self.tree(piece.encode(), pool)
        return np.array(ids, np.uint32)

    def encode(self, text: str, unsplit: bool = True, wide: bool = True, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
        """unsplit: it may have a long piece; wide: it may have unsettled characters."""
        wide = wide and bool(_SETTLED.search(text))
        if self.core is None or wide and not unsplit:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.cut is None or not any(x in text for x in self.special):
            return self.plain(text, unsplit, wide, pool)
        parts = [np.array([self.special[x]], np.uint32) if k % 2 else self.plain(x, unsplit, wide, pool) for k, x in enumerate(self.cut.split(text))]
        return np.concatenate(parts)

    def encode_slice(self, part: Slice, pool: ThreadPoolExecutor | None = None) -> list[np.ndarray]:
        """Only texts with a run of letters or of blanks over the leaf size are split piece by piece."""
        words = words_of(part.data, part.offsets, SPACED, hashed=False)
        owner = words.owner()
        unsplit, wide = np.zeros(len(part), bool), np.zeros(len(part), bool)
        unsplit[owner[words.end - words.start > self.leaf]] = True
        unsplit |= np.diff(part.offsets) > np.bincount(owner, words.end - words.start, len(part)) + self.leaf
        filled = np.diff(part.offsets) > 0
        if filled.any():
            wide[filled] = np.maximum.reduceat(part.data, part.offsets[:-1][filled]) >= 0xC8
        return [self.encode(part.text(i).decode(), bool(unsplit[i]), bool(wide[i]), pool) for i in range(len(part))]

    def decode_flat(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes] | pa.Array:
        """Texts of the ids that `cuts` cuts apart; bytes that aren't UTF-8 become U+FFFD."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], lengths)
        data, offsets = self.bytes[at], ends[cuts]
        raw = data.tobytes()
        try:
            raw.decode()
            whole = not np.any((data[offsets[:-1][np.diff(offsets) > 0]] & 0xC0) == 0x80)
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ids(part: Slice, bpe: ByteBPE, pool: ThreadPoolExecutor) -> tuple[np.ndarray, np.ndarray]:
    found = bpe.encode_slice(part, pool)
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
    return np.concatenate([np.empty(0, np.uint32), *found]).astype(np.int64), cuts


def _lists(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids; with decoded=True also the text decoded from these ids."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        with ThreadPoolExecutor(2) as pool:
            for part in slices(batches, max_bytes=1 << 20):
                flat, cuts = _ids(part, bpe, pool)
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(cuts), pa.int64()), "ids": _lists(flat, cuts)}
                if decoded:
                    columns["decoded"] = bpe.decode_flat(flat, cuts)
                yield pa.record_batch(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_tokens long, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(frame: DataFrame, *, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of its ids; null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1).to_pylist()
                cuts = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists], dtype=np.int64)])
                flat = np.array([t for x in lists for t in x or ()], np.int64)
                yield pa.record_batch([part.column(0), bpe.decode_flat(flat, cuts)], names=["doc_id", "text"])

    return frame.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
