"""Byte-level BPE by reduction of a tree: encode halves, join neighbours, decode by concatenation up the tree.

Encodings of neighbouring texts form a monoid under ``join``. Joining encodes a window of tokens on both sides of the
seam anew and takes the result as soon as the tokens outside provably stay as they are, else doubles the window. An
edge of the window (between characters a and b) is proved in one of two ways.

* Every match of the pattern that contains a ends there: a is a letter, digit or mark and b is of another class, with
  the apostrophe and white space as exceptions (``fixed``). Both sides are then encoded apart.
* a and b lie inside one match, and the tokens x, y on both sides of the edge re-encode to (x, y). A sequence of tokens
  of one match is its encoding if all its adjacent pairs re-encode to themselves: before the first merge across any
  token's edge, each pair's bytes go through the very merges they go through alone, and alone no merge crosses the
  edge; so none ever does, and each token forms by itself.

A window that covers both halves is always right, so joining ends. Characters whose class has changed since Unicode 3.2
never prove an edge.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamloom.llm.memory import frugal
from beamloom.llm.tokens import batches

#: Characters of a leaf of the tree, and tokens on each side of the first window.
LEAF = 512
WINDOW = 4
#: Rows and bytes of text worked on at once.
ROWS = 512
BATCH_BYTES = 1 << 20


@lru_cache(4096)
def kind(c: str) -> str:
    """L(etter), N(umber), S(pace), A(postrophe), O(ther); empty where versions of Unicode may disagree."""
    if c == "'":
        return "A"
    if c.isspace():
        return "" if "\x1c" <= c <= "\x1f" else "S"
    now, old = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
    if "Cn" in (now, old) or now[0] in "LN" and now[0] != old[0] or old[0] in "LN" and now[0] != old[0]:
        return ""
    return now[0] if now[0] in "LN" else "O"


def fixed(a: str, b: str) -> bool:
    """A match always ends between these characters, and what follows is matched as at the start of a text."""
    x, y = kind(a), kind(b)
    if x == "A":
        return y in ("N", "S")
    return bool(y) and x in ("L", "N", "O") and (y != x) and not (x == "O" and y == "A")


class Bpe:
    """Encoding and decoding by a file of ranks and a pattern that splits the text before merging."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.leaf, self.window = leaf, window

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        half = len(text) // 2
        return self.join(self.encode(text[:half]), self.encode(text[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def join(self, left: list[int], right: list[int]) -> list[int]:
        k = self.window
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            while i and self._inside(left[i]):
                i -= 1
            while j < len(right) and self._inside(right[j]):
                j += 1
            middle = self.encoding.encode_ordinary(b"".join(map(self.bytes.__getitem__, left[i:] + right[:j])).decode())
            if (not i or self._stays(left[max(0, i - 4) : i], middle[0])) and (j == len(right) or self._stays(middle[-4:], right[j])):
                return left[:i] + middle + right[j:]
            k *= 2

    def _inside(self, token: int) -> bool:
        """The token begins in the middle of a character."""
        return self.bytes[token][0] & 0xC0 == 0x80

    def _stays(self, before: list[int], after: int) -> bool:
        tail = b"".join(map(self.bytes.__getitem__, before)).decode(errors="ignore")[-3:]
        b = self.bytes[after].decode(errors="ignore")[:1]
        if not b or not tail:
            return False
        if fixed(tail[-1], b):
            return True
        if "'" in tail + b or len(tail) < 3 or kind(b) not in ("L", "N", "O") or kind(b) != kind(tail[-1]):
            return False
        x = before[-1]
        return self.encoding._core_bpe.encode_single_piece(self.bytes[x] + self.bytes[after]) == [x, after]


@lru_cache(2)
def _bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def _lists(ids: list[list[int]], width: pa.DataType) -> pa.Array:
    edges = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=edges[1:])
    flat = np.fromiter((t for x in ids for t in x), np.int32, int(edges[-1]))
    return pa.ListArray.from_arrays(edges, pa.array(flat, width))


def _coded(docs: DataFrame, path: str, pattern: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    """All columns of other names, ``ids`` and, if asked for, the bytes that they decode to; one worker does both, few rows at a time."""
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    names = kept if text in kept else [*kept, text]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.BinaryType(), False)] if decoded else [])
    schema = T.StructType([*rows.schema.fields[: len(kept)], *new])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for b in parts:
            for at in range(0, b.num_rows, ROWS):
                part, done = b.slice(at, ROWS), 0
                for texts in batches([t or "" for t in part.column(names.index(text)).to_pylist()], BATCH_BYTES):
                    found = [bpe.encode(t) for t in texts]
                    columns = [_lists(found, pa.int32())]
                    if decoded:
                        columns.append(pa.array(map(bpe.decode, found), pa.binary()))
                    yield pa.RecordBatch.from_arrays([*part.slice(done, len(texts)).columns[: len(kept)], *columns], names=schema.names)
                    done += len(texts)

    return rows.mapInArrow(frugal(run), schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns and ``out``, the ids of the whole text as array<int>; a column of that name is replaced.

    A null is an empty text (no ids). Repeated rows give repeated results; an empty table gives an empty table.
    """
    return _coded(docs, path, pattern, text, out, None)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode``, and ``decoded``, the bytes that the ids stand for: a round trip in one pass."""
    return _coded(docs, path, pattern, text, ids, decoded)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and ``out``, the bytes that the ids stand for (binary: ids need not end on a whole character).

    Null ids decode to empty bytes; an id that the ranks don't have fails the job.
    """
    kept = [c for c in encoded.columns if c != out]
    rows = encoded.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for b in parts:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = pa.array([bpe.decode(x or []) for x in part.column(place).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, got], names=schema.names)

    return rows.mapInArrow(frugal(run), schema)
