"""Substring deduplication by relative Lempel-Ziv parsing (operator 8).

Every document is factored against the blocks of all others (and its own earlier and later ones).
Reference blocks are the stretches of windows between content-defined anchors, indexed by anchor and
content hash; so each block of each document is in the index, wherever its text is shifted to.  A
document is parsed from left to right: a block found in the index opens a factor, which grows as long
as the next block goes on in the same reference.  At factor boundaries, where a block as a whole has
no equal but its anchor does, the block's windows are looked up one by one, so that nothing is lost
where two passages join.  Factors of at least one window (35 words) are duplicate spans.

Blocks that repeat are counted before they are shuffled, and equal blocks become one row, so that a
passage in a third of all documents stays small; no pairs of documents are made.

Defined results: a null or empty text has no words; texts shorter than a window lose nothing; every
occurrence of a repeated window goes, the first too; a row that repeats a doc_id is another place of its
words, with the same text or with another; rows without doc_id are left out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Windows, by_document, covered, repeated, unlike, variants
from .textkit import ROW_KEY, keyed_texts, slices, words

WINDOW_WORDS = 35
ANCHOR_WORDS = 8


def _windows(window: int) -> Windows:
    return Windows(window, max(1, min(ANCHOR_WORDS, window // 2)))


def duplicate_blocks(texts: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Runs of repeated windows of ``keyed_texts`` with one other place of theirs: doc_id, start, n, ref_doc, ref_start.

    ``start`` and ``ref_start`` count words; a run covers ``n - 1 + window`` words.
    """
    windows = _windows(window)
    blocks = repeated(texts, windows)
    kinds = variants(blocks)
    here = F.struct("doc_id", "start")
    other = F.when(F.col("first") == here, F.col("last")).otherwise(F.col("first"))
    whole = blocks.drop("n", "lead").join(kinds.where("copies > 1"), ["anchor", "whole"]).select(
        "doc_id", "start", F.col("n").cast("int").alias("n"), other["doc_id"]["doc_id"].alias("ref_doc"), other["start"].alias("ref_start")
    )
    edges = unlike(kinds).select(F.col("first.doc_id").alias("doc_id"), "first.start", F.col("n").cast("int").alias("n"), "anchor")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for lo, hi, raw, off in slices(batch.column(1)):
                symbols, first = windows.symbols(raw, off)
                part = spans.slice(lo, hi - lo)
                item = part.flatten()
                row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                begin, n = item.field(0).to_numpy().astype(np.int64), item.field(1).to_numpy().astype(np.int64)
                each = np.repeat(np.arange(len(begin)), n)
                start = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                key = windows.window_hashes(symbols, first[:-1][row[each]] + start)
                yield pa.RecordBatch.from_arrays(
                    [item.field(2).take(pa.array(each)), pa.array(key.view(np.int64)),
                     batch.column(0).slice(lo, hi - lo).take(pa.array(row[each])), pa.array(start.astype(np.int32))],
                    ["anchor", "window", "doc_id", "start"],
                )

    single = texts.join(by_document(edges, "start", "n", "anchor"), "doc_id").select("doc_id", "text", "spans").mapInArrow(
        look_up, f"anchor long, window long, doc_id {ROW_KEY}, start int"
    )
    met = single.groupBy("anchor", "window").agg(F.count("*").alias("copies"), F.min(here).alias("first"), F.max(here).alias("last")).where("copies > 1")
    found = single.join(met, ["anchor", "window"]).select(
        "doc_id", "start", F.lit(1).alias("n"), other["doc_id"]["doc_id"].alias("ref_doc"), other["start"].alias("ref_start")
    )
    return whole.unionByName(found)


def parse(spans: tuple[np.ndarray, ...], window: int) -> tuple[np.ndarray, ...]:
    """Greedy factors (start, length, ref_doc, ref_start) of one document from its runs of windows.

    Runs that go on in the same reference are one factor.  From left to right a factor is taken if it
    reaches beyond all before it; of those that start together the longest.
    """
    start, n, ref_doc, ref_start = spans
    shift = ref_start - start
    order = np.lexsort((start, shift, ref_doc))
    start, n, ref_doc, shift = start[order], n[order], ref_doc[order], shift[order]
    if not len(start):
        return start, n, ref_doc, start
    # The reach of one reference never counts for the next: each has a range of its own.
    other = np.append(False, (ref_doc[1:] != ref_doc[:-1]) | (shift[1:] != shift[:-1]))
    base = np.cumsum(other) * ((start + n).max() + 1)
    reach = np.maximum.accumulate(base + start + n)
    heads = np.flatnonzero(np.append(True, other[1:] | (base[1:] + start[1:] > reach[:-1])))
    ends = np.maximum.reduceat(start + n, heads)
    start, ref_doc, shift = start[heads], ref_doc[heads], shift[heads]
    order = np.lexsort((-ends, start))
    start, ends, ref_doc, shift = start[order], ends[order], ref_doc[order], shift[order]
    taken = np.append(True, ends[1:] > np.maximum.accumulate(ends)[:-1])
    start, ends, ref_doc, shift = start[taken], ends[taken], ref_doc[taken], shift[taken]
    return start, ends - start + window - 1, ref_doc, start + shift


def factor(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) and the factors of every document."""
    return _factored(docs, window).withColumn("doc_id", F.col("doc_id.doc_id"))


def _factored(docs: DataFrame, window: int) -> DataFrame:
    """``factor`` with the key of the row as doc_id."""
    texts = keyed_texts(docs)
    spans = by_document(duplicate_blocks(texts, window), "start", "n", "ref_doc", "ref_start")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(1)):
                starts, ends, first = words(raw, off)
                data, rows = raw.tobytes(), []
                part = batch.column(2).slice(lo, hi - lo)
                item, sizes = part.flatten(), part.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                fields = [item.field(k).to_numpy().astype(np.int64) for k in range(4)]
                to = np.cumsum(sizes)
                for r in range(hi - lo):
                    own = tuple(f[to[r] - sizes[r] : to[r]] for f in fields)
                    a, b = starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]]
                    parsed = parse(own, window)
                    gone = covered(len(a), parsed[0], parsed[1], 1)
                    kept = b" ".join([data[x:y] for x, y in zip(a[~gone].tolist(), b[~gone].tolist())])
                    factors = [dict(zip(("start", "length", "ref_doc", "ref_start"), f)) for f in zip(*(x.tolist() for x in parsed))]
                    rows.append((len(a), int(gone.sum()), kept.decode(), factors))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                     pa.array(columns[3], pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "ref_doc", "ref_start")])))],
                    ["doc_id", "n_words", "n_removed", "kept_text", "factors"],
                )

    joined = texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        apply, f"doc_id {ROW_KEY}, n_words long, n_removed long, kept_text string, factors array<struct<start long, length long, ref_doc long, ref_start long>>"
    )


def substring_dedup(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; n_chars, if there, follows the text."""
    cut = _factored(docs, window).where("n_removed > 0").groupBy(F.col("doc_id").alias("_cut")).agg(F.first("kept_text").alias("_kept"))
    key = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("mark"))
    out = docs.join(cut, key == cut["_cut"], "left")
    text = F.when(F.col("_cut").isNotNull(), F.col("_kept")).otherwise(docs["text"])
    columns = [
        text.alias(c) if c == "text" else F.when(F.col("_cut").isNotNull(), F.length("_kept").cast(t)).otherwise(docs[c]).alias(c) if c == "n_chars" else docs[c]
        for c, t in docs.dtypes
    ]
    return out.select(*columns)
