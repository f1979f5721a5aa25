"""Residuals of cross-sections on industry and size.

Regressing on an intercept and industry dummies leaves each value's distance from
its group's mean, so no matrix is built: every method is a few windows on
(factor, date).  With size as well, both variables are demeaned by group and one
slope is left (Frisch, Waugh and Lovell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ASSET, DATE, over
from ..plans.errors import ConfigurationError, NeutralizationError

METHODS = ("ols", "filtered", "wls", "ridge", "mcap", "industry_mcap", "index")
#: Cells that a date needs, those of them with an asset in the industry map, and rows of an industry under ``filtered``.
MIN_CELLS, MIN_COMMON, MIN_GROUP = 10, 5, 5


def _marked(panel: DataFrame) -> DataFrame:
    """Adds the cell's group and whether its date counts.

    A null label of a known asset belongs to the smallest label present, the one that a regression takes as its base.
    """
    if "industry" not in panel.columns:
        raise NeutralizationError("the panel has no industry; attach_industry adds it")
    w = over(*DATE)
    ok = F.col("value").isNotNull() & F.col("known")
    label = F.when(ok, F.col("industry"))
    x = panel.select(
        "*", ok.alias("__ok"), F.count("value").over(w).alias("__n"), F.sum(ok.cast("int")).over(w).alias("__common"), F.min(label).over(w).alias("__base"), F.max(label).over(w).alias("__top")
    )
    enough = (F.col("__n") >= MIN_CELLS) & (F.col("__common") >= MIN_COMMON)
    return x.select("*", F.when(F.col("__ok"), F.coalesce("industry", "__base")).alias("__group"), (F.col("__ok") & enough).alias("__use"), (F.col("__base") < F.col("__top")).alias("__many"))


def _finish(x: DataFrame, residual: Column, zero_fill: bool) -> DataFrame:
    out = F.when(F.col("__use"), residual)
    return x.withColumn("value", F.coalesce(out, F.lit(0.0)) if zero_fill else out).drop("__ok", "__n", "__common", "__base", "__top", "__group", "__use", "__many")


def neutralize(panel: DataFrame, method: str = "ols", alpha: float = 1.0, zero_fill: bool = True) -> DataFrame:
    """Residual values; cells and dates that don't count become 0 (or null without ``zero_fill``).

    ols: industry; a date with one industry keeps its values. filtered: industries below five
    rows and dates with one industry become 0, assets without a label are left out. wls: means weighted by mcap. ridge: group
    effects shrunk by n/(n+alpha). mcap: log size. industry_mcap: both. index: each asset on the mean of the dates, through time.
    """
    if method not in METHODS:
        raise ConfigurationError(f"unknown neutralization {method!r}", context={"known": METHODS})
    if method == "filtered":
        return _filtered(panel, zero_fill)
    if method == "index":
        return _index(panel)
    x = _marked(panel)
    v, group, date = F.col("value"), over(*DATE, "__group"), over(*DATE, "__use")
    if method == "ols":
        return _finish(x, F.when(F.coalesce("__many", F.lit(False)), v - F.avg("value").over(group)).otherwise(v), zero_fill)
    if method == "ridge":
        mean, n = F.avg("value").over(date), F.count("value").over(group)
        return _finish(x, v - mean - n / (n + alpha) * (F.avg("value").over(group) - mean), zero_fill)
    if "mcap" not in panel.columns:
        raise NeutralizationError(f"{method} needs mcap; attach_mcap adds it")
    if method == "wls":
        w = F.when(F.col("mcap") > 0, F.col("mcap"))
        return _finish(x, v - F.sum(v * w).over(group) / F.sum(F.when(v.isNotNull(), w)).over(group), zero_fill)
    size = F.when(F.col("mcap") > 0, F.log("mcap"))
    x = x.withColumn("__use", F.col("__use") & size.isNotNull())
    part = over(*DATE, "__group", "__use") if method == "industry_mcap" else date
    x = x.withColumn("__y", v - F.avg("value").over(part)).withColumn("__x", size - F.avg(size).over(part))
    slope = F.sum(F.col("__x") * F.col("__y")).over(date) / F.nullif(F.sum(F.col("__x") * F.col("__x")).over(date), F.lit(0.0))
    return _finish(x, F.col("__y") - F.coalesce(slope, F.lit(0.0)) * F.col("__x"), zero_fill).drop("__x", "__y")


def _filtered(panel: DataFrame, zero_fill: bool) -> DataFrame:
    g, w = F.when(F.col("value").isNotNull(), F.col("industry")), over(*DATE)
    x = panel.withColumn("__g", g)
    x = x.select("*", F.count("__g").over(w).alias("__n"), (F.min("__g").over(w) < F.max("__g").over(w)).alias("__many"), F.count("__g").over(over(*DATE, "__g")).alias("__ng"))
    use = F.col("__g").isNotNull() & (F.col("__n") >= MIN_CELLS) & F.col("__many") & (F.col("__ng") >= MIN_GROUP)
    out = F.when(use, F.col("value") - F.avg("value").over(over(*DATE, "__g")))
    return x.withColumn("value", F.coalesce(out, F.lit(0.0)) if zero_fill else out).drop("__g", "__n", "__many", "__ng")


def _index(panel: DataFrame) -> DataFrame:
    """Each asset's residual on the equal-weighted mean of the dates."""
    x = panel.withColumn("__m", F.avg("value").over(over(*DATE)))
    w, m = over(*ASSET), F.when(F.col("value").isNotNull(), F.col("__m"))
    slope = F.covar_pop("value", "__m").over(w) / F.nullif(F.var_pop(m).over(w), F.lit(0.0))
    return x.withColumn("value", F.col("value") - F.avg("value").over(w) - F.coalesce(slope, F.lit(0.0)) * (F.col("__m") - F.avg(m).over(w))).drop("__m")
