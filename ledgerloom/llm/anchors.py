"""Places that equal windows share: the common part of the two substring deduplications.

A window is ``window`` neighbouring symbols (words or bytes) of one document.  Its anchor is the
gram of ``gram`` symbols inside it with the least hash, the leftmost among equals.  Neighbouring
windows mostly have the same anchor; such a run of windows is a *stretch*.  Equal windows have equal
anchors at equal places, so all that can ever match meets under the anchor's hash, and an anchor that
occurs once rules out all windows of its stretch.  About two symbols in ``window - gram`` are anchors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .textkit import ROW_KEY, Rolling, mix, owners, per_slice, ragged, window_argmin, words

_WORD, _GRAM, _TEXT = Rolling(801), Rolling(811), Rolling(821)


@dataclass(frozen=True)
class Windows:
    """Length of the windows and of the anchors, in words or in bytes."""

    window: int
    gram: int
    bytewise: bool = False

    def symbols(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a slice as numbers, and the first symbol of each row."""
        if self.bytewise:
            return raw, off
        starts, ends, first = words(raw, off)
        return _WORD.spans(raw, starts, ends), first

    def stretches(self, symbols: np.ndarray, first: np.ndarray):
        """(row, start, windows, lead, anchor hash, hash of the whole stretch) of every stretch.

        ``start`` counts from the row's first symbol; ``lead`` is the anchor's place in the stretch.
        """
        none = np.zeros(0, np.int64)
        counts = np.maximum(0, np.diff(first) - self.window + 1)
        at = ragged(first[:-1], counts)
        if not len(at):
            return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        begin = np.arange(len(symbols) - self.gram + 1)
        gram = _GRAM.spans(symbols, begin, begin + self.gram)
        anchor = window_argmin(gram, self.window - self.gram + 1)[at]
        row = np.repeat(np.arange(len(counts)), counts)
        head = np.ones(len(at), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        heads = np.flatnonzero(head)
        n = np.diff(np.append(heads, len(at)))
        start, anchor, row = at[heads], anchor[heads], row[heads]
        lead = anchor - start
        whole = mix(_TEXT.spans(symbols, start, start + n - 1 + self.window) + lead.astype(np.uint64))
        return row, start - first[:-1][row], n, lead, gram[anchor], whole

    def window_hashes(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _TEXT.spans(symbols, starts, starts + self.window)


def repeated(texts: DataFrame, windows: Windows) -> DataFrame:
    """Stretches of ``keyed_texts`` whose anchor occurs more than once: anchor, whole, doc_id, start, n, lead (a written table)."""

    def run(ids, raw, off):
        symbols, first = windows.symbols(raw, off)
        row, start, n, lead, anchor, whole = windows.stretches(symbols, first)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), ids.take(pa.array(row)),
             pa.array(start.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(lead.astype(np.int16))],
            ["anchor", "whole", "doc_id", "start", "n", "lead"],
        )

    schema = f"anchor long, whole long, doc_id {ROW_KEY}, start int, n short, lead short"
    stretches = texts.mapInArrow(per_slice(run), schema)
    shared = stretches.groupBy("anchor").count().where("count > 1")
    return materialise(texts.sparkSession, stretches.join(shared, "anchor", "left_semi"), "stretches")


def variants(stretches: DataFrame) -> DataFrame:
    """Equal stretches as one row: anchor, whole, copies, first and last (doc_id, start), n, lead."""
    place = F.struct("doc_id", "start")
    return stretches.groupBy("anchor", "whole").agg(
        F.count("*").alias("copies"), F.min(place).alias("first"), F.max(place).alias("last"), F.max("n").alias("n"), F.max("lead").alias("lead")
    )


def unlike(kinds: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """Variants whose anchor also has other variants (``least`` to ``most`` in all): their windows must be compared one by one."""
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= least)
    if most is not None:
        several = several.where(F.col("kinds") <= most)
    return kinds.join(several.select("anchor"), "anchor", "left_semi")


def by_document(spans: DataFrame, *columns: str) -> DataFrame:
    """All spans of a document as one row; there are at most as many as the document has symbols."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("spans"))


def covered(size: int, starts: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of ``size`` symbols lie in a window that starts in one of the runs (start, n)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0
