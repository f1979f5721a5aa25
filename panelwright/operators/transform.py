"""Changes of shape: log, quantile, Box-Cox, Yeo-Johnson, and the gate that asks whether one is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ASSET, sample_kurtosis, sample_skew
from ..plans.errors import ConfigurationError

METHODS = ("auto", "none", "log", "quantile", "box_cox", "yeo_johnson")
#: The powers tried, in tenths.
GRID = tuple(range(-20, 21))


def yeo_johnson(x: Column, power: Column) -> Column:
    up = F.when(power == 0, F.log1p(x)).otherwise((F.pow(x + 1, power) - 1) / power)
    down = F.when(power == 2, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - power) - 1) / (2 - power))
    return F.when(x >= 0, up).when(x < 0, down)


def box_cox(x: Column, power: Column) -> Column:
    return F.when(x > 0, F.when(power == 0, F.log(x)).otherwise((F.pow(x, power) - 1) / power))


def fit_power(panel: DataFrame, kind: str) -> DataFrame:
    """(factor, power): the grid's power with the largest profile likelihood, ties to the smallest size, then value.

    A row meets each power inside its own task and is aggregated there at once, so what is shuffled is a row per power.
    """
    x, power = F.col("value"), F.col("g") / 10
    curve, jacobian = (yeo_johnson, F.signum(x) * F.log1p(F.abs(x))) if kind == "yeo_johnson" else (box_cox, F.when(x > 0, F.log(x)))
    tried = panel.select("factor", "value", F.explode(F.array(*map(F.lit, GRID))).alias("g"))
    stats = tried.groupBy("factor", "g").agg(F.count(jacobian).alias("n"), F.sum(jacobian).alias("j"), F.var_pop(curve(x, power)).alias("v")).where("v > 0")
    fit = F.round(-F.col("n") / 2 * F.log("v") + (power - 1) * F.col("j"), 6)
    best = F.max(F.struct(fit.alias("fit"), (-F.abs("g")).alias("near"), (-F.col("g")).alias("low")))
    return stats.groupBy("factor").agg(best.alias("b")).select("factor", (-F.col("b.low") / 10).alias("power"))


def reshape(panel: DataFrame, method: str = "auto") -> DataFrame:
    """Apply a method. auto and none change nothing; log is sign(x) ln(1+|x|); quantile is the asset's percent rank;
    the power curves use one power per factor, and cells outside a curve's range stay as they are.
    """
    if method not in METHODS:
        raise ConfigurationError(f"unknown transformation {method!r}", context={"known": METHODS})
    x = F.col("value")
    if method == "log":
        return panel.withColumn("value", F.signum(x) * F.log1p(F.abs(x)))
    if method == "quantile":
        rank = F.percent_rank().over(Window.partitionBy(*ASSET, x.isNull()).orderBy(F.round(x, 9)))
        return panel.withColumn("value", F.when(x.isNotNull(), rank))
    if method in ("box_cox", "yeo_johnson"):
        curve = yeo_johnson if method == "yeo_johnson" else box_cox
        return panel.join(fit_power(panel, method), "factor", "left").withColumn("value", F.coalesce(curve(x, F.col("power")), x)).drop("power")
    return panel


def asset_moments(panel: DataFrame) -> DataFrame:
    v = F.col("value")
    return panel.groupBy(*ASSET).agg(
        F.count(v).alias("n"), F.median(v).alias("median"), F.percentile(v, F.lit(0.05)).alias("q05"), F.percentile(v, F.lit(0.95)).alias("q95"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), sample_skew(v).alias("skew"), sample_kurtosis(v).alias("kurt"),
    )


def needs_transform(panel: DataFrame, skew: float = 2.0, kurtosis: float = 5.0) -> DataFrame:
    """(factor, skew, kurt, needed): medians over assets against the limits."""
    by = asset_moments(panel).groupBy("factor").agg(F.median("skew").alias("skew"), F.median("kurt").alias("kurt"))
    return by.withColumn("needed", F.coalesce((F.abs("skew") > skew) | (F.col("kurt") > kurtosis), F.lit(False)))
