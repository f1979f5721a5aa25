"""Filling of missing cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ASSET, DATE, over
from ..plans.errors import ConfigurationError

METHODS = ("auto", "median", "mean", "most_frequent", "constant", "cross_section_mean", "ffill", "hierarchical")


def _most_frequent(panel: DataFrame) -> DataFrame:
    times = F.count("value").over(over(*ASSET, "value"))
    seen = panel.withColumn("__n", F.when(F.col("value").isNotNull(), times))
    best = F.max(F.struct("__n", (-F.col("value")).alias("v"))).over(over(*ASSET))  # ties go to the smallest value
    return seen.withColumn("value", F.coalesce("value", -best["v"])).drop("__n")


def impute(panel: DataFrame, strategy: str = "auto", fill_value: float | None = None) -> DataFrame:
    """Fill nulls. auto is the asset's median; an asset without any value keeps its nulls, except under
    constant and the cross-section methods. ffill carries the last value forward in time; hierarchical
    falls back from that to the industry's mean of the date, the date's mean, and the asset's median.
    """
    value, asset = F.col("value"), over(*ASSET)
    past = F.last("value", ignorenulls=True).over(Window.partitionBy(*ASSET).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    fills: dict[str, list[Column]] = {
        "median": [F.median("value").over(asset)],
        "mean": [F.avg("value").over(asset)],
        "cross_section_mean": [F.avg("value").over(over(*DATE))],
        "ffill": [past],
    }
    fills["auto"] = fills["median"]
    if strategy == "most_frequent":
        return _most_frequent(panel)
    if strategy == "constant":
        return panel.withColumn("value", F.coalesce(value, F.lit(0.0 if fill_value is None else float(fill_value))))
    if strategy == "hierarchical":
        carried = panel.withColumn("__fill", past).withColumn("__median", F.median("value").over(asset))
        return carried.withColumn(
            "value", F.coalesce("value", "__fill", F.avg("value").over(over(*DATE, "industry")), F.avg("value").over(over(*DATE)), "__median")
        ).drop("__fill", "__median")
    if strategy not in fills:
        raise ConfigurationError(f"unknown imputation strategy {strategy!r}", context={"known": METHODS})
    return panel.withColumn("value", F.coalesce(value, *fills[strategy]))


def fit_medians(panel: DataFrame) -> DataFrame:
    """(factor, asset, fill): medians of one panel for filling another."""
    return panel.groupBy(*ASSET).agg(F.median("value").alias("fill"))


def apply_fills(panel: DataFrame, fills: DataFrame) -> DataFrame:
    return panel.join(fills, list(ASSET), "left").withColumn("value", F.coalesce("value", "fill")).drop("fill")


def missing_kind(panel: DataFrame) -> DataFrame:
    """Per factor, what its gaps look like: none, related to the level (the asset's mean), or neither.

    The correlation of an asset's share of gaps with its mean tells the last two apart.
    """
    by = panel.groupBy(*ASSET).agg(F.avg(F.col("value").isNull().cast("double")).alias("gap"), F.avg("value").alias("mean"))
    link = F.coalesce(F.abs(F.corr("gap", "mean")), F.lit(0.0))
    return by.groupBy("factor").agg(
        F.avg("gap").alias("missing_rate"), link.alias("level_link"), F.when(F.max("gap") == 0, "none").when(link > 0.3, "level_related").otherwise("random").alias("kind")
    )
