"""Autoregressive orders and residuals, and the decoupler built of them.

Autocovariances of an asset are aggregates over its lags; the Durbin-Levinson
recursion over them is unrolled into column expressions, so no series leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ASSET, over
from ..plans.errors import ConfigurationError
from .neutralize import neutralize

CRITERIA = ("aic", "bic", "hqic")


def _penalty(criterion: str, p: int, n: Column) -> Column:
    if criterion not in CRITERIA:
        raise ConfigurationError(f"unknown criterion {criterion!r}", context={"known": CRITERIA})
    return {"aic": F.lit(2.0 * p), "bic": p * F.log(n), "hqic": 2.0 * p * F.log(F.log(n))}[criterion]


def autocovariances(panel: DataFrame, lags: int) -> DataFrame:
    """(factor, asset, n, mean, g0 .. g<lags>): sums of products of centred values over n."""
    mean = F.avg("value").over(over(*ASSET))
    order = Window.partitionBy(*ASSET).orderBy("date")
    x = panel.select("factor", "asset", "date", mean.alias("mean"), (F.col("value") - mean).alias("c"))
    x = x.select("*", *[F.lag("c", k).over(order).alias(f"c{k}") for k in range(1, lags + 1)])
    n = F.count("c")
    return x.groupBy(*ASSET).agg(
        n.alias("n"), F.first("mean").alias("mean"), (F.sum(F.col("c") * F.col("c")) / n).alias("g0"),
        *[(F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)) / n).alias(f"g{k}") for k in range(1, lags + 1)],
    )


def ar_fit(panel: DataFrame, max_order: int = 5, criterion: str = "aic") -> DataFrame:
    """(factor, asset, n, mean, p, phi, sigma2): the order with the least criterion (the smaller on a tie) and its coefficients.

    An asset with fewer than max_order + 2 values, or a constant one, has order 0.
    """
    fits = autocovariances(panel, max_order).withColumn("s0", F.col("g0"))
    for m in range(1, max_order + 1):
        # reflection, then the coefficients and variance of order m from those of order m - 1
        carried = sum((F.col(f"a{m - 1}_{j}") * F.col(f"g{m - j}") for j in range(1, m)), F.lit(0.0))
        fits = fits.withColumn(f"k{m}", F.when(F.col(f"s{m - 1}") > 0, (F.col(f"g{m}") - carried) / F.col(f"s{m - 1}")).otherwise(0.0))
        fits = fits.select(
            "*",
            *[(F.col(f"a{m - 1}_{j}") - F.col(f"k{m}") * F.col(f"a{m - 1}_{m - j}")).alias(f"a{m}_{j}") for j in range(1, m)],
            F.col(f"k{m}").alias(f"a{m}_{m}"),
            (F.col(f"s{m - 1}") * (1 - F.col(f"k{m}") * F.col(f"k{m}"))).alias(f"s{m}"),
        )
    n = F.col("n").cast("double")
    usable = (F.col("n") >= max_order + 2) & (F.col("g0") > 1e-12)
    choices = []
    for p in range(max_order + 1):
        score = F.round(n * F.log(F.col(f"s{p}")) + _penalty(criterion, p, n), 6)
        phi = F.array(*[F.col(f"a{p}_{j}") for j in range(1, p + 1)]) if p else F.array().cast("array<double>")
        choices.append(F.when(usable & (F.col(f"s{p}") > 0), F.struct((-score).alias("good"), F.lit(-p).alias("np"), phi.alias("phi"), F.col(f"s{p}").alias("sigma2"))))
    best = F.array_max(F.array(*choices))
    return fits.select(
        "factor", "asset", "n", "mean", F.coalesce(-best["np"], F.lit(0)).alias("p"), F.coalesce(best["phi"], F.array().cast("array<double>")).alias("phi"),
        F.coalesce(best["sigma2"], F.col("g0")).alias("sigma2"),
    )


def ar_residual(panel: DataFrame, max_order: int = 5, criterion: str = "aic", strength: float = 1.0) -> DataFrame:
    """Innovations: each value less ``strength`` times its forecast's distance from the mean.

    The first p values of an asset and those with a gap among their p predecessors stay; the mean stays in.
    """
    fit = ar_fit(panel, max_order, criterion).select(*ASSET, "p", "phi", "mean")
    order = Window.partitionBy(*ASSET).orderBy("date")
    past = F.array(*[F.lag("value", k).over(order) for k in range(1, max_order + 1)])
    x = panel.withColumn("__past", past).join(fit, list(ASSET), "left")
    terms = F.zip_with("phi", F.slice("__past", F.lit(1), F.greatest("p", F.lit(0))), lambda a, b: a * (b - F.col("mean")))
    forecast = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return x.withColumn("value", F.coalesce(F.col("value") - F.lit(strength) * forecast, "value")).drop("__past", "p", "phi", "mean")


def decouple(panel: DataFrame, max_order: int = 5, criterion: str = "aic", strength: float = 1.0) -> DataFrame:
    """Neutralize, take innovations, neutralize those; strength below 1 takes only that part of each fit away."""
    use_size = "mcap" in panel.columns
    method = "industry_mcap" if use_size else "ols"

    def softened(x: DataFrame) -> DataFrame:
        if strength == 1:
            return neutralize(x, method)
        kept = neutralize(x.withColumn("__x", F.col("value")), method)
        return kept.withColumn("value", F.col("__x") * (1 - strength) + strength * F.col("value")).drop("__x")

    return softened(ar_residual(softened(panel), max_order, criterion, strength))


def decouple_summary(panel: DataFrame, max_order: int = 5, criterion: str = "aic") -> DataFrame:
    """Per factor: spread before and after each neutralization, and the orders chosen between."""
    one = neutralize(panel, "ols")
    fit = ar_fit(one, max_order, criterion).groupBy("factor").agg(F.avg("p").alias("mean_order"), F.max("p").alias("max_order"), F.avg(F.sqrt("sigma2")).alias("residual_std"))
    spread = panel.groupBy("factor").agg(F.stddev_samp("value").alias("std_before"), F.countDistinct("industry").alias("industry_count"), F.countDistinct("asset").alias("stock_count"))
    after = one.groupBy("factor").agg(F.stddev_samp("value").alias("std_after"))
    return spread.join(after, "factor").join(fit, "factor")
