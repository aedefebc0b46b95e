"""Quality rules as an isolation forest on rule statistics (operator 7).

Every document gets its rule statistics in one pass.  Each tree of random splits draws its own
``PER_TREE`` documents from the whole table: those whose hash, salted by the tree, is least.  Trees
are grown one a task.  A document that random splits set apart after few steps is an anomaly.  The
score above which a document goes is calibrated on all labelled rows: the lowest cut that keeps
``KEEP_GOOD`` of the good ones, found exactly by counting the scores' bits 16 at a time.

Defined results: a null or blank text has no words and fails the base rules; with no labelled good
rows nothing is cut by score; rows without doc_id get statistics and a verdict too; rows that repeat
a doc_id are each judged, and each counts as labelled; repeated rows get equal results and are drawn
together; equal scores are all kept or all cut; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .textkit import SPACE, Rolling, crc_share, mix, numbers, owners, per_slice, texts_of, words

TREES, PER_TREE, SEED = 128, 256, 7
KEEP_GOOD = 0.98
HELD_OUT_PARTS = 5

_HASH = Rolling(701)
#: Documents drawn for a tree before the ``PER_TREE`` least are taken, on average: as many are missed with a chance below 1e-30.
_DRAWN = 2 * PER_TREE
_NODE = "tree int, node int, feature int, value double, left int, right int, path double"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def statistics(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Rule statistics of every row of a slice."""
    rows = len(off) - 1
    starts, ends, first = words(raw, off)
    solid = ~SPACE[raw]
    out = {"n_words": np.diff(first), "word_chars": _per_row(solid & ((raw & 0xC0) != 0x80), off), "n_symbols": _per_row(_SYMBOL[raw], off)}
    # Lines: a row's text cut at line feeds.
    breaks = np.flatnonzero(raw == 0x0A)
    line_row = np.concatenate([np.arange(rows), np.searchsorted(off, breaks, "right") - 1])
    begin = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((begin, line_row))
    begin, line_row = begin[order], line_row[order]
    end = np.append(begin[1:] - 1, 0)
    last = np.append(line_row[1:] != line_row[:-1], True)
    end[last] = off[1:][line_row[last]]
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(solid, out=total[1:])
    worded = total[end] > total[begin]
    begin, end, line_row = begin[worded], end[worded], line_row[worded]
    key = mix(_HASH.spans(raw, begin, end) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[at], minlength=rows)
    # Words in windows of three that the row has more than once.
    row = owners(first)
    cover = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= 3:
        word = _HASH.spans(raw, starts, ends)
        own = row[:-2] == row[2:]
        three = mix(mix(word[:-2] * np.uint64(3) + word[1:-1]) * np.uint64(5) + word[2:] + row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(own)
        at = at[np.argsort(three[at], kind="stable")]
        same = three[at][1:] == three[at][:-1]
        again = at[np.append(same, False) | np.insert(same, 0, False)] if len(at) else at
        np.add.at(cover, again, 1)
        np.add.at(cover, again + 3, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)
    return out


def _statistic_rows(ids, raw, off):
    found = statistics(raw, off)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(found[c].astype(np.int64)) for c in _COUNTS)], ["doc_id", *_COUNTS])


def features(frame: pd.DataFrame) -> np.ndarray:
    """Ratios that the trees split on."""
    words_, lines = np.maximum(1, frame["n_words"]), np.maximum(1, frame["n_lines"])
    chars = np.maximum(1, frame["word_chars"])
    return np.stack(
        [frame["word_chars"] / words_, frame["n_symbols"] / chars, frame["n_dup_lines"] / lines, frame["n_repeat_words"] / words_], axis=1
    ).astype(float)


def grow(rows: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """One isolation tree: split feature and value, children (-1 in a leaf) and the path length of leaves; node 0 is the root."""
    nodes: list[list] = []
    most = int(np.ceil(np.log2(max(2, len(rows)))))

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([0, 0.0, -1, -1, 0.0])
        wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= most or not len(wide):
            nodes[at][4] = depth + _mean_path(len(rows))
            return at
        f = int(rng.choice(wide))
        v = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        below = rows[:, f] < v
        nodes[at][:4] = [f, v, add(rows[below], depth + 1), add(rows[~below], depth + 1)]
        return at

    add(rows, 0)
    return pd.DataFrame(nodes, columns=["feature", "value", "left", "right", "path"])


class Forest:
    """Isolation trees side by side in arrays, with the number of rows that each was grown on."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(per_tree, len(rows))
        self._join([grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees if len(rows) else 0)], size)

    @classmethod
    def of(cls, trees: list[pd.DataFrame], size: int) -> Forest:
        """Forest of trees grown elsewhere."""
        out = cls.__new__(cls)
        out._join(trees, size)
        return out

    def _join(self, trees: list[pd.DataFrame], size: int) -> None:
        first = np.concatenate([[0], np.cumsum([len(t) for t in trees])]).astype(int)
        self.roots = first[:-1].tolist()
        whole = lambda name, kind: np.concatenate([np.zeros(0, kind), *(t[name].to_numpy(kind) for t in trees)])
        self.feature, self.value, self.path = whole("feature", int), whole("value", float), whole("path", float)
        shift = np.repeat(first[:-1], np.diff(first))
        self.left, self.right = (np.where(child >= 0, child + shift, -1) for child in (whole("left", int), whole("right", int)))
        self.scale = max(1e-9, _mean_path(size))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, 0 to 1: high where random splits isolate it early."""
        total = np.zeros(len(rows))
        everyone = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            while True:
                inner = self.left[node] >= 0
                if not inner.any():
                    break
                f = self.feature[node]
                goes = np.where(rows[everyone, f] < self.value[node], self.left[node], self.right[node])
                node = np.where(inner, goes, node)
            total += self.path[node]
        return 2.0 ** (-total / max(1, len(self.roots)) / self.scale)


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def forest_of(counted: DataFrame, rows: int, trees: int = TREES, seed: int = SEED) -> Forest:
    """Forest over a table of ``rows`` statistics: every tree draws from all of them and grows in a task of its own."""
    salt = numbers(trees, seed)
    share = np.uint64(min(2**64 - 1, _DRAWN * 2**64 // max(1, rows)))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Rows that nothing tells apart go on as one with their number.
            key, at, times = np.unique(frame["key"].to_numpy().view(np.uint64), return_index=True, return_counts=True)
            frame = frame[_COUNTS].iloc[at].assign(times=np.minimum(times, PER_TREE))
            for tree in range(trees):
                place = mix(key ^ salt[tree])
                taken = place <= share
                if taken.any():
                    yield frame[taken].assign(tree=tree, place=(place[taken] >> np.uint64(1)).astype(np.int64))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", *_COUNTS]).head(PER_TREE)
        least = features(frame.loc[frame.index.repeat(frame["times"])].head(PER_TREE))
        nodes = grow(least, np.random.default_rng([seed, int(key[0])]))
        return nodes.assign(tree=key[0], node=np.arange(len(nodes)))[[f.split()[0] for f in _NODE.split(", ")]]

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    keyed = counted.select(F.xxhash64("doc_id", *_COUNTS).alias("key"), *_COUNTS)
    grown = keyed.mapInPandas(draw, f"{counts}, times long, tree int, place long").groupBy("tree").applyInPandas(build, _NODE)
    # At most 2 * PER_TREE - 1 nodes a tree.
    nodes = grown.toPandas().sort_values(["tree", "node"])
    return Forest.of([tree for _, tree in nodes.groupby("tree")], min(PER_TREE, rows))


def calibrate(good: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """Lowest cut that keeps the wanted share of the good rows, from the bits of their scores (``bits``).

    Positive doubles order as their bits do.  Four counts by 16 bits each narrow the range that
    holds the wanted rank; at most 65,536 counts of one range reach the driver.
    """
    total = good.count()
    if not total:
        return 1.0
    wanted = int(np.ceil(keep_good * (total - 1)))
    prefix = 0
    for shift in (48, 32, 16, 0):
        inside = good if shift == 48 else good.where(F.shiftright("bits", shift + 16) == prefix)
        for row in inside.groupBy(F.shiftright("bits", shift).alias("range")).count().orderBy("range").collect():
            prefix = row["range"]
            if wanted < row["count"]:
                break
            wanted -= row["count"]
    return float(np.int64(prefix).view(np.float64))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed, kept and the anomaly score of every document."""
    spark = docs.sparkSession
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)
    counted = materialise(spark, texts_of(docs).mapInArrow(per_slice(_statistic_rows), schema), "rule-statistics")
    sent = spark.sparkContext.broadcast(forest_of(counted, counted.count()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score(features(pa.Table.from_batches([batch]).select(_COUNTS).to_pandas()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score.view(np.int64))], [*batch.schema.names, "anomaly", "bits"])

    judged = materialise(spark, counted.mapInArrow(judge, schema + ", anomaly double, bits long"), "rule-scores")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("_id").isNotNull() & F.col("quality").isNotNull() & (crc_share("_id", HELD_OUT_PARTS) != 0))
        .groupBy("_id").agg(F.min("quality").alias("quality"))
        .where("quality = 1")
    )
    good = judged.select("doc_id", "bits").join(known, F.col("doc_id") == F.col("_id")).select("bits")
    cut = calibrate(materialise(spark, good, "good-scores"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("anomaly") <= cut)).alias("kept"), "anomaly",
    )
