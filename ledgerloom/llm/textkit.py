"""Vectorised text helpers for Arrow batches: slices, words, hashes, window minima.

Everything here works on the bytes of a few documents at a time (a *slice*), with numpy
arrays as long as the slice, so that memory is bounded by the slice and by the longest
single document.  Hashes are 64 bits wide, fixed, and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 20

#: The blanks of every contract: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[0x41:0x5B] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MASK64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit pseudo-random numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _GOLDEN)


class Rolling:
    """Polynomial hash modulo 2**64 of any span of a sequence, from one prefix sum."""

    def __init__(self, seed: int):
        self.base = int(numbers(1, seed)[0]) | 5
        self.symbol = numbers(256, seed + 1)
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up), SLICE_BYTES + 1)
            inverse = pow(self.base, -1, 1 << 64)
            for name, base in (("_up", self.base), ("_down", inverse)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:end]`` (64-bit numbers, or bytes) for every span."""
        self._tables(len(values) + 1)
        if values.dtype == np.uint8:
            values = self.symbol[values]
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._up[: len(values)], out=total[1:])
        out = total[ends]
        out -= total[starts]
        out *= self._down[starts]
        out += (ends - starts).astype(np.uint64) * _GOLDEN
        return mix(out)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``most`` bytes.

    Yields (first row, row after the last, bytes, offsets of the rows in these bytes).  A
    null row has no bytes.  A single longer row is a slice of its own, never cut.
    """
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of non-blank bytes: (start, end) of each word, and the first word of each row.

    The last array has one entry more than there are rows.
    """
    solid = ~SPACE[raw]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    filled = off[:-1] < off[1:]
    heads, tails = off[:-1][filled], off[1:][filled] - 1
    begin[heads] = solid[heads]
    stop[tails] = solid[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def owners(first: np.ndarray) -> np.ndarray:
    """Row number of every item, from the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least key in every run of ``width`` neighbours.

    Keys are compared by their upper 32 bits, so that equal runs give equal places wherever they are.
    """
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 32) - 1)
    best = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[:n], best[width - reach : width - reach + n])
    return (best & low).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given runs, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(begin - starts, lengths)


def strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).cast(pa.string())


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: consecutive ``counts`` values of ``values`` in each row."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), data]).cast(pa.binary())


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and whole text, null as empty; columns that the caller does not name stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


#: Type of a row's key: rows with one doc_id and unlike texts are rows of their own.
ROW_KEY = "struct<doc_id:bigint,mark:bigint>"


def row_key(doc_id: str = "doc_id", text: str = "text") -> F.Column:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.struct(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("mark"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``texts_of`` with the row's key (see ``row_key``) as doc_id; rows without doc_id are left out."""
    return texts_of(docs).where("doc_id IS NOT NULL").select(row_key().alias("doc_id"), "text")


def per_slice(make: Callable) -> Callable:
    """Turn ``make(ids, raw, off) -> RecordBatch or None`` into a mapInArrow function.

    ``ids`` is the first column's slice as numpy, ``raw`` and ``off`` are the text column's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, off in slices(batch.column(1)):
                out = make(ids.slice(lo, hi - lo), raw, off)
                if out is not None:
                    yield out

    return run


def crc_share(column: str, parts: int) -> F.Column:
    """crc32 of the id written as text, modulo ``parts`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))
