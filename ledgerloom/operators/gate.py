"""Quality gate over candidate rows (see ``extract.extract_candidates``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pass mark and weights of the four signals.
PASS_MARK = 0.75
WEIGHTS = {"completeness": 0.4, "format_validity": 0.2, "ocr": 0.2, "math_audit": 0.2}
# Reconciliation tolerance (absolute, share of total) and mismatch score.
ABS_TOLERANCE, REL_TOLERANCE, MISMATCH_SCORE = 1.0, 0.02, 0.3
VENDOR_BONUS = 0.1


def _one(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def completeness() -> Column:
    found = (
        _one(F.col("invoice_number").isNotNull())
        + _one(F.col("invoice_date").isNotNull() | F.col("due_date").isNotNull())
        + _one(F.col("total_amount").isNotNull())
    ) / 3
    has_vendor = F.length(F.coalesce("vendor", F.lit(""))) > 0
    return F.when(has_vendor, F.least(F.lit(1.0), found + VENDOR_BONUS)).otherwise(found)


def format_validity() -> Column:
    """Mean of the checks that apply; 0.5 when none does."""
    checks = (
        F.when(F.col("invoice_number").isNotNull(), _one(F.col("invoice_number").rlike(r"\p{Nd}"))),
        F.when(F.col("total_amount").isNotNull(), _one(F.col("total_amount") > 0)),
        F.when(
            F.col("invoice_date").isNotNull() & F.col("due_date").isNotNull(),
            _one(F.col("due_date") >= F.col("invoice_date")),
        ),
    )
    applied = sum((_one(c.isNotNull()) for c in checks), F.lit(0.0))
    met = sum((F.coalesce(c, F.lit(0.0)) for c in checks), F.lit(0.0))
    return F.when(applied == 0, 0.5).otherwise(met / applied)


def ocr_score() -> Column:
    return F.coalesce("ocr_confidence", F.lit(1.0))


def items_total() -> Column:
    """Sum of the item amounts of a row, in item order."""
    return F.aggregate(
        F.filter(F.transform("line_items", lambda i: i["amount"]), lambda a: a.isNotNull()),
        F.lit(0.0),
        lambda total, a: total + a,
    )


def math_audit(items_sum: Column) -> Column:
    """1.0 when items and total agree or there is nothing to audit."""
    nothing = (
        F.col("line_items").isNull() | (F.size("line_items") == 0) | F.col("total_amount").isNull() | (items_sum == 0)
    )
    tolerance = F.greatest(F.lit(ABS_TOLERANCE), F.col("total_amount") * REL_TOLERANCE)
    agrees = F.abs(items_sum - F.col("total_amount")) <= tolerance
    return F.when(nothing | agrees, 1.0).otherwise(MISMATCH_SCORE)


def line_item_audit(headers: DataFrame, items: DataFrame, id_column: str = "id") -> DataFrame:
    """The same audit from an item table: per-document sum against the total.

    Input: headers(id, total_amount), items(id, amount).
    """
    sums = items.groupBy(id_column).agg(F.sum("amount").alias("items_total"), F.count("*").alias("n_items"))
    joined = headers.join(sums, id_column, "left")
    total = F.col("total_amount").cast("double")
    nothing = F.col("n_items").isNull() | total.isNull() | (F.coalesce("items_total", F.lit(0)) == 0)
    agrees = F.abs(F.col("items_total").cast("double") - total) <= F.greatest(F.lit(ABS_TOLERANCE), total * REL_TOLERANCE)
    return joined.withColumn("math_audit", F.when(nothing | agrees, 1.0).otherwise(MISMATCH_SCORE))


def score_candidates(df: DataFrame) -> DataFrame:
    """Add the four signals, the score (4 decimals) and the pass decision.

    The decision uses the unrounded score.  Non-candidates get NULLs.
    """
    signals = F.transform(
        F.array(items_total()),
        lambda items_sum: F.struct(
            completeness().alias("completeness"),
            format_validity().alias("format_validity"),
            ocr_score().alias("ocr_score"),
            math_audit(items_sum).alias("math_audit"),
        ),
    )

    def scored(s: Column) -> Column:
        raw = (
            s["completeness"] * WEIGHTS["completeness"]
            + s["format_validity"] * WEIGHTS["format_validity"]
            + s["ocr_score"] * WEIGHTS["ocr"]
            + s["math_audit"] * WEIGHTS["math_audit"]
        )
        return F.struct(
            *[s[n].alias(n) for n in ("completeness", "format_validity", "ocr_score", "math_audit")],
            F.round(raw, 4).alias("gate_score"),
            (raw >= PASS_MARK).alias("gate_passed"),
        )

    result = F.transform(signals, scored)
    return df.select("*", F.inline_outer(F.when(F.col("document_type").isNotNull(), result)))
