"""Scaling to comparable units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ASSET, DATE, over, quantile
from ..plans.errors import ConfigurationError

METHODS = ("auto", "z_score", "rank", "min_max", "robust")


def standardize(panel: DataFrame, method: str = "auto", mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """auto and z_score use the asset's mean and deviation (an exact 0 counts as 1); robust its median and quartile
    range (0 counts as 1); min_max its range (a constant becomes 0); rank the percent rank on the date.
    """
    x, w = F.col("value"), over(*ASSET)
    if method in ("auto", "z_score"):
        sd = F.stddev_samp("value").over(w)
        new = (x - F.avg("value").over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
    elif method == "robust":
        spread = quantile(x, 0.75).over(w) - quantile(x, 0.25).over(w)
        new = (x - F.median("value").over(w)) / F.when(spread == 0, 1.0).otherwise(spread)
    elif method == "min_max":
        low, high = F.min("value").over(w), F.max("value").over(w)
        return panel.withColumn("value", F.when(x.isNotNull(), F.when(high > low, (x - low) / (high - low)).otherwise(0.0)))
    elif method == "rank":
        rank = F.percent_rank().over(Window.partitionBy(*DATE, x.isNull()).orderBy(F.round(x, 9)))
        return panel.withColumn("value", F.when(x.isNotNull(), rank))
    else:
        raise ConfigurationError(f"unknown standardization {method!r}", context={"known": METHODS})
    return panel.withColumn("value", new if (mean, std) == (0.0, 1.0) else F.lit(mean) + F.lit(std) * new)
