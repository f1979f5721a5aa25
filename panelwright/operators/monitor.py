"""Fingerprint history: migrations between types, stability and weights for a transition.

History is an append-only table (factor, as_of, primary_type, ar1_median, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .classify import PRIORS, classify
from .fingerprint import fingerprint


def history_by_year(panel: DataFrame, min_window: int = 6) -> DataFrame:
    """A history of one fingerprint per factor and calendar year, made in one job: a factor's year is a factor of its own."""
    # a year has no @, so the first one ends it, whatever the factor is called
    yearly = panel.withColumn("factor", F.concat(F.year("date").cast("string"), F.lit("@"), "factor"))
    prints = fingerprint(yearly, min_window)
    both = prints.join(classify(prints), "factor")
    year, name = F.substring_index("factor", "@", 1), F.expr("substring(factor, instr(factor, '@') + 1)")
    return both.select(name.alias("factor"), F.make_date(year.cast("int"), F.lit(12), F.lit(31)).alias("as_of"), "primary_type", "confidence", "ar1_median", "rank_autocorr")


def latest(history: DataFrame) -> DataFrame:
    """The last row of each factor."""
    rows = [c for c in history.columns if c != "factor"]
    return history.groupBy("factor").agg(F.max_by(F.struct(*rows), "as_of").alias("r")).select("factor", *[f"r.{c}" for c in rows])


def migrations(history: DataFrame, current: DataFrame | None = None, threshold: float = 0.10, window: int = 12) -> DataFrame:
    """Factors whose type differs from the history's last one and whose ar1 moved by more than the threshold.

    ``current`` (factor, primary_type, ar1_median) is compared and not appended; without it, each history's last row is compared with the one before.
    """
    w = Window.partitionBy("factor").orderBy(F.col("as_of").desc())
    old = history.withColumn("k", F.row_number().over(w))
    if current is None:
        current, at = old.where("k = 1"), 2
    else:
        at = 1
    old = old.where(F.col("k") == at).select("factor", F.col("primary_type").alias("from_type"), F.col("ar1_median").alias("old_ar1"))
    x = old.join(current.select("factor", F.col("primary_type").alias("to_type"), F.col("ar1_median").alias("new_ar1")), "factor")
    moved = F.abs(F.col("new_ar1") - F.col("old_ar1"))
    alerts = x.where((F.col("from_type") != F.col("to_type")) & (moved > threshold))
    jump = F.array(F.col("from_type"), F.col("to_type"))
    critical = F.array_contains(jump, "STATIC") & F.array_contains(jump, "DYNAMIC")
    return alerts.select(
        "factor", F.when(critical, "CRITICAL").otherwise("WARNING").alias("level"), "from_type", "to_type", moved.alias("ar1_change"), F.lit(window).alias("window"),
        F.when(critical, "rebuild the pipeline").otherwise("blend both pipelines").alias("recommendation"),
    )


def stability(history: DataFrame) -> DataFrame:
    """(factor, n, stability): the share of the history that has its most frequent type."""
    by = history.groupBy("factor", "primary_type").agg(F.count("*").alias("k"))
    return by.groupBy("factor").agg(F.sum("k").alias("n"), (F.max("k") / F.sum("k")).alias("stability"))


def transition_weights(prints: DataFrame) -> DataFrame:
    """(factor, static, mixed, dynamic): weights of the pipelines by closeness of ar1 to each type's prior mean."""
    e = {t: F.exp(-F.abs(F.col("ar1_median") - m)) for t, (m, _) in PRIORS.items()}
    total = sum(e.values(), F.lit(0.0))
    return prints.select("factor", *[(v / total).alias(t.lower()) for t, v in e.items()])
