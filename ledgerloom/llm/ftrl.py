"""Logistic regression over hashed word grams, trained by FTRL-proximal updates.

Shared by the toxicity and the quality classifier (operators 3 and 6).  A text becomes the set
of hashed grams of its tokens; a token is a run of letters and digits, or a run of other
non-blank characters.  Training keeps a rate per coordinate and sets coordinates with little
evidence to exactly zero (L1), so that the weights sent to the executors are a short list of
(coordinate, weight), never longer than the hash space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER_ASCII, SPACE, Rolling, crc_share, mix, owners, packed, slices, texts_of

_HASH = Rolling(301)
_INSIDE = np.zeros(256, bool)
for _part in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100)):
    _INSIDE[list(_part)] = True


@dataclass(frozen=True)
class Grams:
    """Which grams a text has: runs of 1..``longest`` tokens, and pairs with gaps."""

    longest: int
    skips: tuple[int, ...] = ()
    lower: bool = True
    bits: int = 20

    def of(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, coordinate) of every gram occurrence; rows are in no special order."""
        if self.lower:
            raw = LOWER_ASCII[raw]
        kind = np.where(SPACE[raw], 0, 1 + _INSIDE[raw]).astype(np.int8)
        begin = kind > 0
        begin[1:] &= kind[1:] != kind[:-1]
        heads = off[:-1][off[:-1] < off[1:]]
        begin[heads] = kind[heads] > 0
        stop = kind > 0
        stop[:-1] &= (kind[1:] != kind[:-1]) | begin[1:]
        tails = off[1:][off[:-1] < off[1:]] - 1
        stop[tails] = kind[tails] > 0
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        row = owners(np.searchsorted(starts, off))
        token = _HASH.spans(raw, starts, ends)
        rows, keys = [row], [token]
        gram = token
        for n in range(2, self.longest + 1):
            m = len(token) - n + 1
            if m <= 0:
                break
            gram = mix(gram[:m] * np.uint64(3) + token[n - 1 :])
            same = row[:m] == row[n - 1 :]
            rows.append(row[:m][same])
            keys.append(gram[same])
        for gap in self.skips:
            m = len(token) - gap - 1
            if m > 0:
                same = row[:m] == row[gap + 1 :]
                rows.append(row[:m][same])
                keys.append(mix(token[:m] * np.uint64(5) + token[gap + 1 :] + np.uint64(gap))[same])
        return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - self.bits)).astype(np.int64)


@dataclass(frozen=True)
class Settings:
    """Rates of FTRL-proximal, and the bound on the labelled rows it is trained on."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    epochs: int = 4
    rows: int = 16384


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out_parts: int, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out.

    The rows with the least hash of the id are taken: a fixed sample of a documented size.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where("_id IS NOT NULL AND label IS NOT NULL")
    sample = (
        known.where(crc_share("_id", held_out_parts) != 0)
        .groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    # ``rows`` bounds the side that is broadcast.
    return texts_of(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def fit(sample: DataFrame, grams: Grams, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights (coordinate -1: the bias).  The sample's rows are bounded, so one task trains."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(1)):
                row, key = grams.of(raw, off)
                pair = np.unique(row << grams.bits | key)
                counts = np.bincount(pair >> grams.bits, minlength=hi - lo)
                coordinates = (pair & ((1 << grams.bits) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), packed(coordinates, counts)], ["doc_id", "label", "grams"]
                )

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        rows = pd.concat(frames) if frames else pd.DataFrame({"doc_id": [], "label": [], "grams": []})
        rows = rows.sort_values("doc_id", kind="stable")
        at, weights = ftrl([np.frombuffer(g, np.int32) for g in rows["grams"]], rows["label"].to_numpy(), 1 << grams.bits, settings)
        yield pd.DataFrame({"at": at, "weight": weights})

    found = (
        sample.mapInArrow(featurise, "doc_id long, label int, grams binary")
        .repartition(1)
        .mapInPandas(train, "at long, weight double")
        .toPandas()
    )
    return found["at"].to_numpy(), found["weight"].to_numpy()


def ftrl(examples: list[np.ndarray], labels: np.ndarray, size: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over binary features; the last coordinate is the bias (no L1)."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for epoch in range(s.epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            at = np.append(examples[i], size)
            zi, root = z[at], np.sqrt(n[at])
            l1 = np.full(len(at), s.l1)
            l1[-1] = 0
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((s.beta + root) / s.alpha + s.l2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / s.alpha * w
            n[at] += g * g
    l1 = np.full(size + 1, s.l1)
    l1[-1] = 0
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2), 0.0)
    at = np.flatnonzero(w)
    return np.where(at == size, -1, at), w[at]


@lru_cache(maxsize=4)
def _dense(at: bytes, weights: bytes, bits: int) -> tuple[np.ndarray, float]:
    at, weights = np.frombuffer(at, np.int64), np.frombuffer(weights, np.float64)
    dense = np.zeros(1 << bits, np.float64)
    dense[at[at >= 0]] = weights[at >= 0]
    return dense, float(weights[at < 0].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], grams: Grams) -> DataFrame:
    """doc_id and score (0 to 1) of every row; one pass, no shuffle."""
    spark = docs.sparkSession
    # At most 2**bits weights of 16 bytes each.
    sent = spark.sparkContext.broadcast((model[0].astype(np.int64).tobytes(), model[1].tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = _dense(*sent.value, grams.bits)
        for batch in batches:
            for lo, hi, raw, off in slices(batch.column(1)):
                row, key = grams.of(raw, off)
                live = dense[key] != 0
                pair = np.unique(row[live] << grams.bits | key[live])
                dot = np.bincount(pair >> grams.bits, dense[pair & ((1 << grams.bits) - 1)], minlength=hi - lo) + bias
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], ["doc_id", "score"]
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")
