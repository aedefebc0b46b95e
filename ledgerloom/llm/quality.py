"""Quality classifier: logistic regression by follow-the-regularised-leader updates (operator 6).

Features are hashed word grams with their case kept, each counted once per document; a document's
score is the sparse dot product of its grams with the non-zero weights.  Labels come only from rows
whose crc32(doc_id) is not divisible by five, at most ``Settings.rows`` of them.

Defined results: as for toxicity; the label is ``quality`` and 1 is predicted from a score of 0.3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .textkit import crc_share

GRAMS = ftrl.Grams(longest=3, lower=False)
SETTINGS = ftrl.Settings()
HELD_OUT_PARTS = 5


def fit(docs: DataFrame, labels: DataFrame, settings: ftrl.Settings = SETTINGS, grams: ftrl.Grams = GRAMS):
    """The sparse weights."""
    return ftrl.fit(ftrl.labelled(docs, labels, "quality", HELD_OUT_PARTS, settings.rows), grams, settings)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: ftrl.Settings = SETTINGS, grams: ftrl.Grams = GRAMS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = ftrl.score(docs, fit(docs, labels, settings, grams), grams)
    return scored.select(
        "doc_id", (crc_share("doc_id", HELD_OUT_PARTS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
