"""Exact deduplication by composable polynomial fingerprints (operator 5).

A text, with every run of blanks made one space, is cut into chunks of 64 KiB.  Each chunk is
hashed on its own: a polynomial over its bytes modulo 2**31 - 1, at four bases.  The hash of a
whole text follows from its chunks alone by length-shifted arithmetic,
``h(ab) = h(a) * base**len(b) + h(b)``, so that chunks may be hashed anywhere, in any order.
Documents with equal length and fingerprints are then compared with the document that stays,
chunk by chunk, each chunk a row of a join; a document that differs anywhere leaves the group.

Defined results: a null text is empty; empty texts are equal to each other; of equal texts the
smallest doc_id stays; a row that repeats a doc_id is judged like any other row; rows without
doc_id are left out of the report (and of the kept rows); an empty table gives an empty report.
Columns besides doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .textkit import SPACE, packed, per_slice, ragged, texts_of

CHUNK_BYTES = 1 << 16
PRIME = (1 << 31) - 1
#: Any four different numbers below PRIME.
BASES = (911382323, 972663749, 1386743521, 2071723013)


@cache
def _powers(base: int) -> np.ndarray:
    out = np.empty(CHUNK_BYTES, np.int64)
    value = 1
    for i in range(CHUNK_BYTES):
        out[i] = value
        value = value * base % PRIME
    return out


def normalise(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of blanks as one space; returns the bytes and the rows' new offsets."""
    blank = SPACE[raw]
    stays = ~blank
    stays[1:] |= ~blank[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    stays[heads] = True
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(stays, out=total[1:])
    return np.where(blank, np.uint8(0x20), raw)[stays], total[off]


def combine(left: int, right: int, right_length: int, base: int) -> int:
    """Fingerprint of two neighbouring stretches from theirs and the right one's length."""
    return (left * pow(base, right_length, PRIME) + right) % PRIME


def chunk_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of each chunk (not empty, neighbours, at most CHUNK_BYTES long)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    exponent = np.repeat(ends - 1, ends - starts) - np.arange(starts[0], ends[-1])
    return np.add.reduceat(raw.astype(np.int64) * _powers(base)[exponent], starts) % PRIME


def fingerprints(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row per base: the fingerprint of every document."""
    length = np.diff(off)
    chunks = -(-length // CHUNK_BYTES)
    nth = ragged(np.zeros(len(length), np.int64), chunks)
    starts = np.repeat(off[:-1], chunks) + nth * CHUNK_BYTES
    ends = np.minimum(starts + CHUNK_BYTES, np.repeat(off[1:], chunks))
    first = np.cumsum(chunks) - chunks
    out = np.zeros((len(BASES), len(length)), np.int64)
    for k, base in enumerate(BASES):
        hashes = chunk_hashes(raw, starts, ends, base)
        out[k][chunks > 0] = hashes[first[chunks > 0]]
        for row in np.flatnonzero(chunks > 1):
            value = 0
            for c in range(first[row], first[row] + chunks[row]):
                value = combine(value, int(hashes[c]), int(ends[c] - starts[c]), base)
            out[k][row] = value
    return out


def _fingerprint_rows(ids, raw, off):
    raw, off = normalise(raw, off)
    f = fingerprints(raw, off)
    view = memoryview(raw)
    sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(off)), pa.array(f[0] << 31 | f[1]), pa.array(f[2] << 31 | f[3]), pa.array(sha)],
        ["doc_id", "length", "low", "high", "text_sha256"],
    )


def _chunk_rows(marks_of):
    """(doc_id, text) to one row per chunk of the normalised text, with what ``marks_of`` tells of the text."""
    from .textkit import slices

    def run(batches):
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(1)):
                marks = marks_of(batch.column(0).slice(lo, hi - lo), raw, off)
                raw, off = normalise(raw, off)
                chunks = np.maximum(1, -(-np.diff(off) // CHUNK_BYTES))
                nth = ragged(np.zeros(hi - lo, np.int64), chunks)
                starts = np.repeat(off[:-1], chunks) + nth * CHUNK_BYTES
                size = np.minimum(CHUNK_BYTES, np.repeat(off[1:], chunks) - starts)
                rows = marks.take(pa.array(np.repeat(np.arange(hi - lo), chunks)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(nth), packed(raw, size)], [*rows.schema.names, "nth", "chunk"])

    return run


_MARKS = "doc_id long, length long, low long, high long, text_sha256 string"
_KEY = ["length", "low", "high"]


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    spark = docs.sparkSession
    texts = texts_of(docs).where("doc_id IS NOT NULL")
    prints = materialise(spark, texts.mapInArrow(per_slice(_fingerprint_rows), _MARKS), "fingerprints")
    alike = prints.groupBy(*_KEY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1").drop("group_size")
    ids = prints.join(alike, _KEY, "left_semi").select("doc_id").distinct()
    # Other rows under one of these ids come too; the join by fingerprint leaves them out again.
    chunks = texts.join(ids, "doc_id", "left_semi").mapInArrow(_chunk_rows(_fingerprint_rows), f"{_MARKS}, nth long, chunk binary")
    rows = chunks.join(alike, _KEY)
    # The text that stays; a row that repeats it is the same text, or is told apart below.
    whole = rows.where("doc_id = keep_id").groupBy(*_KEY, "nth").agg(F.min("chunk").alias("kept_chunk"))
    differs = (
        rows.join(whole, [*_KEY, "nth"], "left")
        .where("NOT (chunk <=> kept_chunk)")
        .select("doc_id", "text_sha256")
        .distinct()
        .withColumn("apart", F.lit(True))
    )
    # A text found to differ is told apart from its group by its SHA-256.
    told = prints.join(differs, ["doc_id", "text_sha256"], "left").withColumn("apart", F.when(F.col("apart"), F.col("text_sha256")).otherwise(F.lit("")))
    key = [*_KEY, "apart"]
    groups = told.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return told.join(groups, key).select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stays = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_stays"), F.col("text_sha256").alias("_sha")).distinct()
    # An id may stay with one of its texts only.
    text = F.regexp_replace(F.coalesce(docs["text"].cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.join(stays, (docs["doc_id"].cast("long") == stays["_stays"]) & (F.sha2(text, 256) == stays["_sha"]), "left_semi")
