"""Toxicity by FTRL-proximal logistic regression (operator 3).

Features are hashed word grams and skip-grams of the lower-cased text, each counted once per
document; per-coordinate rates and L1 leave a few thousand weights, which are broadcast.
Labels come only from rows whose crc32(doc_id) is not divisible by five, at most
``Settings.rows`` of them.

Defined results: null and empty texts get the score of the bias; rows without doc_id are scored
too (held_out is null); labels without doc_id or value are not learned from; a doc_id with several
labels counts as toxic if one says so; repeated rows get equal scores; with no labels every score
is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .textkit import crc_share

GRAMS = ftrl.Grams(longest=2, skips=(1, 2), lower=True)
SETTINGS = ftrl.Settings()
HELD_OUT_PARTS = 5


def fit(docs: DataFrame, labels: DataFrame, settings: ftrl.Settings = SETTINGS, grams: ftrl.Grams = GRAMS):
    """The sparse weights."""
    return ftrl.fit(ftrl.labelled(docs, labels, "toxic", HELD_OUT_PARTS, settings.rows), grams, settings)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, settings: ftrl.Settings = SETTINGS, grams: ftrl.Grams = GRAMS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = ftrl.score(docs, fit(docs, labels, settings, grams), grams)
    return scored.select(
        "doc_id", (crc_share("doc_id", HELD_OUT_PARTS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
