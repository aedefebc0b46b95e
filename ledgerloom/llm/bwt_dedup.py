"""Suffix-array deduplication by column-wise multi-document construction (operator 10).

A byte goes if it lies in a 100-byte string that also starts earlier in the collection.

Documents of any length would need as many rounds as the longest has bytes, so the collection is cut
into pieces first: the stretches of windows that share an anchor (``anchors``).  Equal pieces become
one; a piece whose anchor occurs nowhere else cannot match.  An anchor with more than ``MOST`` unlike pieces
is split (``halved``) until no group is larger.  What is left is dealt by anchor or group, and the pieces of
some groups at a time, lined up on their anchors, are indexed column by column from right to left: every round
inserts one symbol of each piece, which sorts the pieces by the text that begins there (the symbols in
that order are the column's Burrows-Wheeler transform) and updates the common prefix of neighbours.
Where the common prefix of neighbours reaches 100, their strings are equal, and all but the
earliest go.  The columns lie in an external file, which is read once, from its first byte to its last; in
memory a part holds one column, the order and the common prefixes.

Defined results: a null text is empty; texts under 100 bytes lose nothing; of equal rows under one doc_id
none is earlier than the other, of unlike texts under one doc_id that with the smaller hash is earlier; rows without doc_id are left out; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .anchors import Windows, by_document, covered, repeated, unlike, variants
from .textkit import ROW_KEY, keyed_texts, packed, ragged, slices

WINDOW_BYTES = 100
ANCHOR_BYTES = 20
#: Unlike pieces of one group, and bytes of pieces (but for one group) indexed at once; neither changes a result.
#: A group of so many pieces of up to 180 bytes is at most a fifth of what is indexed at once.
MOST, _HELD = 1 << 16, 1 << 26


def _windows(window: int) -> Windows:
    return Windows(window, max(1, min(ANCHOR_BYTES, window // 2)), bytewise=True)


def later_strings(group: np.ndarray, rank: np.ndarray, lead: np.ndarray, n: np.ndarray, text: np.ndarray, off: np.ndarray, window: int, file) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window of the piece) of every window that an earlier piece of its group also has.

    Pieces must be sorted by ``group``; a lower ``rank`` is earlier.  ``file`` takes the columns.
    """
    pieces = len(group)
    size = np.diff(off)
    left, right = int(lead.max()), int((size - lead).max())
    # Columns from right to left; a piece that has no symbol in a column gets 0, others byte + 1.
    at = lead - left
    for column in range(right - 1, -left - 1, -1):
        place = column + lead
        inside = (place >= 0) & (place < size)
        symbol = np.zeros(pieces, np.uint16)
        symbol[inside] = text[off[:-1][inside] + place[inside]].astype(np.uint16) + 1
        file.write(symbol.tobytes())
    file.seek(0)
    order, common = np.arange(pieces), np.zeros(pieces, np.int64)
    found_piece, found_at = [], []
    for column in range(right - 1, -left - 1, -1):
        symbol = np.frombuffer(file.read(2 * pieces), np.uint16)[order]
        before = np.argsort(group[order] * 257 + symbol, kind="stable")
        bwt = symbol[before]
        prefix = np.zeros(pieces, np.int64)
        same = np.flatnonzero((bwt[1:] == bwt[:-1]) & (bwt[1:] > 0) & (group[order[before[1:]]] == group[order[before[:-1]]])) + 1
        if len(same):
            # The least common prefix between two old places that are neighbours now.
            bounds = np.stack([before[same - 1] + 1, before[same] + 1], axis=1).ravel()
            prefix[same] = np.minimum.reduceat(np.append(common, 0), bounds)[::2] + 1
        order, common = order[before], prefix
        equal = common >= window
        if equal.any():
            member = equal | np.append(equal[1:], False)
            own = order[member]
            cls = np.cumsum(~equal)[member]
            by = np.lexsort((rank[own], cls))
            own, cls = own[by], cls[by]
            # Of each class the earliest stays, with all that share its place.
            head = np.ones(len(own), bool)
            head[1:] = cls[1:] != cls[:-1]
            first = rank[own][head][np.cumsum(head) - 1]
            later = own[rank[own] > first]
            found_piece.append(later)
            found_at.append(column + lead[later])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_piece]), np.concatenate([none, *found_at])


def by_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column as tables of about ``_HELD`` bytes; rows of one group stay together."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size > _HELD:
            other = np.flatnonzero(batch.column(0).to_numpy() != held[-1].column(0)[-1].as_py())
            cut = int(other[0]) if len(other) else batch.num_rows
            if cut:
                held.append(batch.slice(0, cut))
            if cut == batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def halved(pieces: DataFrame, windows: Windows) -> DataFrame:
    """Each piece as one or two, by how many bytes its windows have before the anchor: ``lo`` .. ``hi`` halved.

    All windows of a half hold ``lo`` bytes before and ``window - gram - hi`` after the anchor.  Equal windows have
    the same half and the same such bytes, so they still meet under the hash of these; other pieces part.
    """
    rest = windows.window - windows.gram
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    ranges = F.array(F.struct("lo", middle.alias("hi")), F.struct((middle + 1).alias("lo"), "hi"))
    halves = pieces.withColumn("half", F.explode(ranges)).select(
        "anchor", "doc_id", "start", "n", "lead", "piece", "half.lo", "half.hi",
        F.least("half.hi", "lead").alias("top"), F.greatest("half.lo", F.col("lead") - F.col("n") + 1).alias("low"),
    ).where("low <= top")
    cut = halves.select(
        "anchor", "doc_id", (F.col("start") + F.col("lead") - F.col("top")).alias("start"), (F.col("top") - F.col("low") + 1).alias("n"),
        F.col("top").alias("lead"), "lo", "hi",
        F.substring("piece", F.col("lead") - F.col("top") + 1, F.col("top") - F.col("low") + windows.window).alias("piece"),
    )
    around = F.substring("piece", F.col("lead") - F.col("lo") + 1, F.col("lo") + windows.gram + rest - F.col("hi"))
    return cut.select(
        F.xxhash64("anchor", "lo", around).alias("anchor"), F.xxhash64("lo", "n", "lead", "piece").alias("whole"),
        "doc_id", "start", "n", "lead", "lo", "hi", "piece",
    )


def repeated_strings(texts: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """Runs of windows that start earlier too: doc_id, start, n (bytes start .. start + n - 1 + window go)."""
    windows = _windows(window)
    stretches = repeated(texts, windows)
    kinds = variants(stretches)

    def later(rows: DataFrame, kinds: DataFrame) -> DataFrame:
        return (
            rows.select("anchor", "whole", "doc_id", "start")
            .join(kinds.where("copies > 1"), ["anchor", "whole"])
            .where(F.struct("doc_id", "start") > F.col("first"))
            .select("doc_id", "start", F.col("n").cast("int").alias("n"))
        )

    def edges(kinds: DataFrame) -> DataFrame:
        return kinds.select(F.col("first.doc_id").alias("doc_id"), "first.start", F.col("n").cast("int").alias("n"), F.col("lead").cast("int").alias("lead"), "anchor")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(1)):
                part = batch.column(2).slice(lo, hi - lo)
                item = part.flatten()
                row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                start, n = item.field(0).to_numpy().astype(np.int64), item.field(1).to_numpy().astype(np.int64)
                size = n - 1 + window
                yield pa.RecordBatch.from_arrays(
                    [item.field(3), batch.column(0).slice(lo, hi - lo).take(pa.array(row)), item.field(0), item.field(1), item.field(2),
                     packed(raw[ragged(off[:-1][row] + start, size)], size)],
                    ["anchor", "doc_id", "start", "n", "lead", "piece"],
                )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_groups(batches):
            yield compared(table.combine_chunks())

    def compared(table: pa.Table) -> pa.RecordBatch:
        anchor, start, n, lead = (table[c].to_numpy().astype(np.int64) for c in ("anchor", "start", "n", "lead"))
        key = table["doc_id"].combine_chunks()
        key = key.chunk(0) if isinstance(key, pa.ChunkedArray) else key
        doc, mark = (key.field(k).to_numpy() for k in (0, 1))
        by = np.lexsort((start, mark, doc, anchor))
        anchor, doc, mark, start, n, lead = anchor[by], doc[by], mark[by], start[by], n[by], lead[by]
        key = key.take(pa.array(by))
        column = table["piece"].combine_chunks().take(pa.array(by))
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(by) + 1].astype(np.int64)
        text = np.frombuffer(data, np.uint8)
        group = np.cumsum(np.append(0, anchor[1:] != anchor[:-1]))
        # Earlier: smaller doc_id (of one doc_id, smaller hash of the text), then the smaller place of the anchor;
        # equal places share a rank.
        place = start + lead
        new = np.append(True, (group[1:] != group[:-1]) | (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (place[1:] != place[:-1]))
        rank = np.cumsum(new)
        with tempfile.TemporaryFile() as file:
            piece, at = later_strings(group, rank, lead, n, text, off, window, file)
        by = np.lexsort((at, piece))
        piece, at = piece[by], at[by]
        head = np.ones(len(piece), bool)
        head[1:] = (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(head)
        return pa.RecordBatch.from_arrays(
            [key.take(pa.array(piece[heads])), pa.array((start[piece[heads]] + at[heads]).astype(np.int32)), pa.array(np.diff(np.append(heads, len(piece))).astype(np.int32))],
            ["doc_id", "start", "n"],
        )

    def fetched(edges: DataFrame) -> DataFrame:
        return texts.join(by_document(edges, "start", "n", "lead", "anchor"), "doc_id").select("doc_id", "text", "spans").mapInArrow(
            fetch, f"anchor long, doc_id {ROW_KEY}, start int, n int, lead int, piece binary"
        )

    def found(pieces: DataFrame) -> DataFrame:
        return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(index, f"doc_id {ROW_KEY}, start int, n int")

    runs = later(stretches, kinds).unionByName(found(fetched(edges(unlike(kinds, most=MOST)))))
    hot = materialise(texts.sparkSession, edges(unlike(kinds, least=MOST + 1)), "hot-anchors")
    large = fetched(hot).withColumns({"lo": F.lit(0), "hi": F.lit(window - windows.gram)})
    span = window - windows.gram + 1
    # At one window a piece the group holds equal windows only, and those are one piece.
    while span > 1 and not hot.isEmpty():
        rows = materialise(texts.sparkSession, halved(large, windows), "halved")
        own = F.struct("doc_id", "start", "lo", "hi", "piece")
        kinds = rows.groupBy("anchor", "whole").agg(F.count("*").alias("copies"), F.min(own).alias("first"), F.max("n").alias("n"), F.max("lead").alias("lead"))
        kinds = materialise(texts.sparkSession, kinds, "halved-kinds")
        places = kinds.withColumn("first", F.struct("first.doc_id", "first.start"))
        pieces = ["anchor", "first.doc_id", "first.start", "n", "lead", "first.piece"]
        runs = runs.unionByName(later(rows, places)).unionByName(found(unlike(kinds, most=MOST).select(*pieces)))
        large = hot = unlike(kinds, least=MOST + 1).select(*pieces, "first.lo", "first.hi")
        span = (span + 1) // 2
    return runs


def suffix_dedup(docs: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes of every document."""
    texts = keyed_texts(docs)
    spans = by_document(repeated_strings(texts, window), "start", "n")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(1)):
                part = batch.column(2).slice(lo, hi - lo)
                item, sizes = part.flatten(), part.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(hi - lo), sizes)
                start, n = item.field(0).to_numpy().astype(np.int64), item.field(1).to_numpy().astype(np.int64)
                gone = covered(len(raw), off[:-1][row] + start, n, window)
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                heads = off[:-1][off[:-1] < off[1:]]
                opens[heads] = gone[heads]
                total, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens))
                removed = total[off[1:]] - total[off[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(removed), pa.array(runs[off[1:]] - runs[off[:-1]]),
                     packed(raw[~gone], np.diff(off) - removed)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    joined = texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    cut = joined.mapInArrow(apply, f"doc_id {ROW_KEY}, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.withColumn("doc_id", F.col("doc_id.doc_id"))
