"""Taming of outliers.

``scope='asset'`` takes bounds from each asset through time; ``scope='panel'`` from
all cells of the factor, by a small fit table that is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ASSET, clip, over, quantile
from ..plans.errors import ConfigurationError
from .quantiles import panel_quantiles

#: Consistency of the median absolute deviation with the normal's deviation.
MAD_SCALE = 1.4826
METHODS = ("auto", "winsorize", "percentile", "z_score", "iqr", "mad", "adaptive", "sigmoid")


def _panel_bounds(panel: DataFrame, method: str, threshold: float, lower: float, upper: float) -> DataFrame:
    """(factor, __low, __high) from all cells of a factor."""
    if method == "z_score":
        mean, reach = F.avg("value"), threshold * F.stddev_samp("value")
        return panel.groupBy("factor").agg((mean - reach).alias("__low"), (mean + reach).alias("__high"))
    if method == "iqr":
        low, high, reach = F.col("q0"), F.col("q1"), 1.5 * (F.col("q1") - F.col("q0"))
        return panel_quantiles(panel, (0.25, 0.75)).select("factor", (low - reach).alias("__low"), (high + reach).alias("__high"))
    return panel_quantiles(panel, (lower, upper)).select("factor", F.col("q0").alias("__low"), F.col("q1").alias("__high"))


def _center(panel: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds __med and __mad."""
    if keys == ASSET:
        return panel.withColumn("__med", F.median("value").over(over(*keys))).withColumn("__mad", F.median(F.abs(F.col("value") - F.col("__med"))).over(over(*keys)))
    med = panel_quantiles(panel, (0.5,)).withColumnRenamed("q0", "__med")
    joined = panel.join(med, list(keys), "left")
    away = joined.withColumn("__away", F.abs(F.col("value") - F.col("__med")))
    return joined.join(panel_quantiles(away, (0.5,), "__away").withColumnRenamed("q0", "__mad"), list(keys), "left")


def tame(panel: DataFrame, method: str = "auto", threshold: float = 3.0, lower: float | None = None, upper: float | None = None, scope: str = "asset") -> DataFrame:
    """Clip to a method's bounds; sigmoid squeezes smoothly instead. auto winsorizes at 5 and 95 %.

    adaptive uses the median's deviation where it isn't 0, else the standard deviation.
    """
    keys = ASSET if scope == "asset" else ("factor",)
    if method not in METHODS:
        raise ConfigurationError(f"unknown outlier method {method!r}", context={"known": METHODS})
    value = F.col("value")
    if method in ("mad", "adaptive", "sigmoid"):
        held, spread = _center(panel, keys), threshold * MAD_SCALE * F.col("__mad")
        if method == "sigmoid":
            new = F.when(spread > 0, F.col("__med") + spread * F.tanh((value - F.col("__med")) / spread)).otherwise(value)
        else:
            new = clip(value, F.col("__med") - spread, F.col("__med") + spread)
            if method == "adaptive":
                sd = threshold * F.stddev_samp("value").over(over(*keys)) if keys == ASSET else F.lit(None)
                new = F.when(F.col("__mad") > 0, new).otherwise(clip(value, F.col("__med") - sd, F.col("__med") + sd))
        return held.withColumn("value", new).drop("__med", "__mad")
    default = (0.05, 0.95) if method in ("auto", "winsorize") else (0.01, 0.99)
    lower, upper = default[0] if lower is None else lower, default[1] if upper is None else upper
    if keys == ASSET:
        w = over(*keys)
        if method == "z_score":
            mean, sd = F.avg("value").over(w), F.stddev_samp("value").over(w)
            return panel.withColumn("value", clip(value, mean - threshold * sd, mean + threshold * sd))
        if method == "iqr":
            q1, q3 = quantile(value, 0.25).over(w), quantile(value, 0.75).over(w)
            return panel.withColumn("value", clip(value, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
        return panel.withColumn("value", clip(value, quantile(value, lower).over(w), quantile(value, upper).over(w)))
    fit = _panel_bounds(panel, method, threshold, lower, upper)
    return panel.join(fit, list(keys), "left").withColumn("value", clip(value, F.col("__low"), F.col("__high"))).drop("__low", "__high")


def fit_sigma_bounds(panel: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """(factor, asset, low, high) at so many deviations around the mean, to be kept from fit to transform."""
    m, s = F.avg("value"), F.stddev_samp("value")
    return panel.groupBy(*ASSET).agg((m - sigmas * s).alias("low"), (m + sigmas * s).alias("high"))


def apply_bounds(panel: DataFrame, bounds: DataFrame) -> DataFrame:
    """Clip to a fit table's bounds; assets that it lacks stay as they are."""
    return panel.join(bounds, list(ASSET), "left").withColumn("value", clip(F.col("value"), F.col("low"), F.col("high"))).drop("low", "high")
