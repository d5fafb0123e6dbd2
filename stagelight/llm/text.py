"""Whole texts as flat bytes: word bounds and position-independent hashes of any span by array arithmetic.

A task never builds Python strings for words. The texts of a slice lie in one uint8 array, prefix sums of
byte values times powers of an odd base give the hash of every span in one subtraction and one product mod 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random value for each byte; the seed fixes every hash of the subpackage.
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 21


def _table(lower: bool, word) -> bytes:
    out = bytearray(256)
    for b in range(256):
        c = b + 32 if lower and 65 <= b <= 90 else b
        out[b] = c if word(c) else 32
    return bytes(out)


#: Lower-cases A-Z and blanks what is no word byte. Bytes from 128 on belong to characters outside ASCII.
ALNUM = _table(True, lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
SPACED = _table(True, lambda c: c != 32 and not 9 <= c <= 13)
LETTERS = _table(True, lambda c: 97 <= c <= 122 or c >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    size = 1 << max(12, (n - 1).bit_length())
    return _powers(size, int(base))[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE^i, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(max(1, len(values)), BASE)[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Raw hash of the spans [start, end); equal spans have equal hashes wherever they stand."""
    return (p[end] - p[start]) * powers(len(p), INVERSE)[start]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, the texts' UTF-8 bytes) in runs of about limit bytes; NULL is empty."""
    first, held, size = 0, [], 0
    column = column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary())
    for i, v in enumerate(column):
        b = v.as_py() or b""
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


class Words:
    """The words of some texts: hash, start and end byte (in buf), row, and the number of words of each row."""

    def __init__(self, texts: list[bytes], table: bytes):
        joined = b" ".join(t.translate(table) for t in texts) + b" "
        self.buf = np.frombuffer(joined, np.uint8)
        gap = np.concatenate(([True], self.buf == 32))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        self.row = np.searchsorted(self.offset, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=len(texts))
        self.bounds = np.concatenate(([0], np.cumsum(self.count)))
        self.hash = mix(span_hash(prefix(BYTE[self.buf]), self.start, self.end)) if len(self.start) else np.zeros(0, np.uint64)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The bytes of each span as a string."""
    length = end - start
    offset = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(offset[-1]) + np.repeat(start - offset[:-1], length)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(buf[at]))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def word_hash(word: bytes) -> int:
    """Hash of one word, equal to that of Words."""
    return int(Words([word], bytes(range(256))).hash[0])


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, mod n; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def held_out(column: str, n: int, r: int) -> Column:
    """True where the remainder is r; rows without an id are never held out."""
    return F.coalesce(remainder(column, n) == r, F.lit(False))


def picked(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under names of their own: other columns may have any name."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
