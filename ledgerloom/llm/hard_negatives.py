"""Hard negatives by a vertical scan of integer vectors (operator 13).

Vectors become blocks of columns: one row of a matrix per dimension, with the least and the greatest value of
each.  An anchor scans a block dimension by dimension, those of its greatest own magnitude first.  After each
group of dimensions a candidate's score lies between its partial score plus the least and plus the greatest
that the dimensions left can add; a bitmap keeps the candidates that can still be among the best.  When no
dimension is left the scores are exact and the best are taken.

Two scans: the first finds each anchor's positives, the second the negatives in the score window of each
positive.  Anchors are a stated query set: packed chunks of at most ``ANCHORS`` meet every block, dealt by
slots, so a task holds one block and one chunk at a time.  A block gives each anchor and window no more rows
than the result can take, and ranking is a window that Spark cuts before its shuffle.

Defined results: rows without vec_id, label or vector, or with a null or non-finite component, take no part;
a shorter vector counts as filled with zeros; scaled components beyond 2**25 count as 2**25, so that sums stay
whole numbers of 64 bits; an anchor's others are the rows with another vec_id; repeated rows count each, an
anchor repeated as it is once; equal scores go by vec_id, then by label; an empty vector scores 0; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score, in hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20
ANCHORS = 256
#: Dimensions read between two looks at the bitmap.
STRIDE = 16
_MOST = 1 << 25


def prepare(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label and whole-number components of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & finite)
    scaled = F.transform(x, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * scale, F.lit(-2.0 * _MOST)), F.lit(2.0 * _MOST))), F.lit(-_MOST)), F.lit(_MOST)).cast("int"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("x"))


def blocks(prepared: DataFrame) -> DataFrame:
    """Columnar blocks: ids, labels and a matrix of (dimension, row), with its number of rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for ids, labels, matrix in _gather(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + n], pa.int64()), pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, np.ascontiguousarray(matrix.T)))],
                ["block", "n", "ids", "labels", "columns"],
            )
            n += 1

    return prepared.select("vec_id", "label", "x").mapInArrow(pack, "block long, n int, ids binary, labels binary, columns binary")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a task in runs that are bounded by rows and by bytes, as (ids, labels, rows x dimensions)."""
    held, n, wide = [], 0, 0
    for batch in batches:
        at = 0
        while at < len(batch):
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            room = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, wide, int(sizes.max())))) - n)
            part = batch.slice(at, room)
            held.append(part)
            n += len(part)
            at += len(part)
            wide = max(wide, int(sizes.max()))
            if n >= min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, wide))):
                yield _dense(held)
                held, n, wide = [], 0, 0
    if held:
        yield _dense(held)


def _dense(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts])
    matrix = np.zeros((len(sizes), int(sizes.max())), np.int32)
    matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = np.concatenate([p.column(2).flatten().to_numpy() for p in parts])
    return tuple(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (0, 1)) + (matrix,)


class Block:
    """Columns of a block, and bounds of each."""

    def __init__(self, n: int, ids: bytes, labels: bytes, columns: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        whole = np.frombuffer(columns, np.int32).reshape(-1, n)
        self.low, self.high = whole.min(1, initial=_MOST).astype(np.int64), whole.max(1, initial=-_MOST).astype(np.int64)
        self.largest = max(1, int(np.abs(whole, dtype=np.int64).max(initial=0)))
        # Sums below 2**53 are exact as doubles, which multiply faster.
        self.exact = whole.astype(np.float64)
        self.whole = whole

    def scan(self, anchor: np.ndarray, alive: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the block that are still alive after every dimension, and their exact scores.

        ``shrink(partial, least, most)`` tells which candidates may stay, given what the rest adds.
        """
        anchor = anchor[: len(self.whole)].astype(np.int64)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low[: len(anchor)], anchor * self.high[: len(anchor)]])[:, order]
        least, most = (np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (ends.min(0), ends.max(0)))
        doubles = int(np.abs(anchor).sum()) * self.largest < 1 << 53
        columns = self.exact if doubles else self.whole.astype(np.int64)
        weights = anchor.astype(np.float64) if doubles else anchor
        at = np.flatnonzero(alive)
        dense = len(at) == alive.size
        partial = np.zeros(len(at), columns.dtype)
        for lo in range(0, len(order), STRIDE):
            dims = order[lo : lo + STRIDE]
            # While many are alive whole columns are read, else only the places that are left.
            block = columns[dims] if dense or 2 * len(at) > alive.size else columns[np.ix_(dims, at)]
            add = weights[dims] @ block
            partial += add if len(add) == len(at) else add[at]
            stay = shrink(partial, int(least[lo + len(dims)]), int(most[lo + len(dims)]))
            if not stay.all():
                at, partial, dense = at[stay], partial[stay], False
            if not len(at):
                break
        return at, partial.astype(np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _best(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((labels, ids, -scores))[:k]


def positives_in(block: Block, anchor_id: int, label: int, anchor: np.ndarray, k: int = POSITIVES) -> tuple[np.ndarray, np.ndarray]:
    """The block's best ``k`` rows of the anchor's label: places and scores."""
    alive = (block.labels == label) & (block.ids != anchor_id)
    at, scores = block.scan(anchor, alive, lambda partial, least, most: partial + most >= _kth(partial, k) + least)
    best = _best(block.ids[at], block.labels[at], scores, k)
    return at[best], scores[best]


def negatives_in(block: Block, label: int, anchor: np.ndarray, windows: np.ndarray, k: int = NEGATIVES) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (lowest, highest) score: the block's best ``k`` rows of other labels within."""

    def shrink(partial, least, most):
        low, high = partial + least, partial + most
        stay = np.zeros(len(partial), bool)
        for lowest, highest in windows:
            may = (high >= lowest) & (low <= highest)
            sure = low[may & (low >= lowest) & (high <= highest)]
            stay |= may & (high >= _kth(sure, k))
        return stay

    at, scores = block.scan(anchor, block.labels != label, shrink)
    out = []
    for lowest, highest in windows:
        inside = np.flatnonzero((scores >= lowest) & (scores <= highest))
        best = inside[_best(block.ids[at[inside]], block.labels[at[inside]], scores[inside], k)]
        out.append((at[best], scores[best]))
    return out


def _chunks(anchors: DataFrame, columns: list[str]) -> DataFrame:
    """Anchors packed into rows of lists, at most ``ANCHORS`` in each."""
    schema = anchors.select(*columns).schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ANCHORS):
                part = batch.slice(lo, ANCHORS)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([c])) for c in part.columns], columns)

    fields = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in schema)
    return anchors.select(*columns).mapInArrow(pack, fields)


def _meet(spark: SparkSession, block_table: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every block with every chunk: both are dealt to slots, a chunk to each of them, a block to one."""
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = block_table.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")).repartition(slots, "slot")
    everywhere = chunks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartition(slots, "slot")
    return dealt.join(everywhere, "slot").drop("slot")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict]]:
    """Each pair of a block and a chunk; a block is opened once for neighbours that share it."""
    number, opened = None, None
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            if row["block"].as_py() != number:
                number = row["block"].as_py()
                opened = Block(row["n"].as_py(), *(row[c].as_buffer() for c in ("ids", "labels", "columns")))
            yield opened, row


def _scan_positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in _rows(batches):
            out = [[], [], [], []]
            vectors, labels = row["x"].values, row["label"].values.to_numpy()
            for i, (key, anchor) in enumerate(zip(row["anchor"].values.to_pylist(), row["anchor_id"].values.to_pylist())):
                at, scores = positives_in(block, anchor, int(labels[i]), vectors[i].values.to_numpy(), k)
                for column, values in zip(out, (np.full(len(at), key), np.full(len(at), anchor), block.ids[at], scores)):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["anchor", "anchor_id", "positive_id", "positive_score"])

    return run


def _scan_negatives(lowest: int, highest: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_label", "negative_score"]
        for block, row in _rows(batches):
            out = [[] for _ in names]
            vectors, labels, positives = row["x"].values, row["label"].values.to_numpy(), row["positives"].values
            for i, (key, anchor) in enumerate(zip(row["anchor"].values.to_pylist(), row["anchor_id"].values.to_pylist())):
                of = positives[i].as_py()
                scores = np.array([p["positive_score"] for p in of], np.int64)
                # Whole scores: lowest * p <= 100 * s <= highest * p.
                windows = np.stack([-(-lowest * scores // 100), highest * scores // 100], 1)
                for p, (at, found) in zip(of, negatives_in(block, int(labels[i]), vectors[i].values.to_numpy(), windows, k)):
                    for column, value in zip(out, (key, anchor, p["place"], p["positive_id"], p["positive_score"])):
                        column.append(np.full(len(at), value))
                    for column, values in zip(out[5:], (block.ids[at], block.labels[at], found)):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names)

    return run


def _rank(score: str, *ties: str) -> list[Column]:
    return [F.col(score).desc(), *(F.col(t).asc() for t in ties)]


def mine(
    spark: SparkSession,
    rows: DataFrame,
    is_anchor: Column | None = None,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    vector: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` is a condition on vec_id and label; by default every 100th id is an anchor.
    """
    prepared = prepare(rows, vector, scale)
    columns = materialise(spark, blocks(prepared), "vector-blocks")
    # An anchor is a row of its own: its id may recur with another label or vector.
    chosen = prepared.where(F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor)
    chosen = chosen.select(F.xxhash64("vec_id", "label", "x").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "x").dropDuplicates(["anchor"])
    chosen = materialise(spark, chosen, "anchors")

    found = _meet(spark, columns, _chunks(chosen, ["anchor", "anchor_id", "label", "x"])).mapInArrow(
        _scan_positives(n_positives), "anchor long, anchor_id long, positive_id long, positive_score long"
    )
    order = Window.partitionBy("anchor").orderBy(*_rank("positive_score", "positive_id"))
    positives = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    per_anchor = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    per_anchor = materialise(spark, per_anchor, "positives")

    negatives = _meet(spark, columns, _chunks(chosen.join(per_anchor, "anchor"), ["anchor", "anchor_id", "label", "x", "positives"])).mapInArrow(
        _scan_negatives(lowest, highest, n_negatives),
        "anchor long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_label long, negative_score long",
    )
    order = Window.partitionBy("anchor", "place").orderBy(*_rank("negative_score", "negative_id", "negative_label"))
    ranked = negatives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
