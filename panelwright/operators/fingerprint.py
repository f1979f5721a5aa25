"""Fingerprints of factors: how they move through time and across assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ASSET, DATE, average_rank, sample_kurtosis, sample_skew
from .quantiles import panel_quantiles

#: The gate's limits on skewness and kurtosis.
SKEW_LIMIT, KURT_LIMIT = 2.0, 5.0
FIELDS = (
    "ar1_median ar1_iqr rank_autocorr half_life vol_cluster skewness_std kurtosis_std js_divergence_mean sd_score complexity_need snr_estimate coverage cs_dispersion"
).split()


def persistence(panel: DataFrame, min_window: int = 24) -> DataFrame:
    """(factor, ar1_median, ar1_iqr, vol_cluster): first-order correlations through time, over assets with enough pairs."""
    w = Window.partitionBy(*ASSET).orderBy("date")
    x = panel.select(*ASSET, "date", "value", F.pow(F.col("value") - F.avg("value").over(Window.partitionBy(*ASSET)), 2).alias("sq"))
    x = x.select("*", F.lag("value").over(w).alias("prev"), F.lag("sq").over(w).alias("prev_sq"))
    pairs = F.count_if(F.col("value").isNotNull() & F.col("prev").isNotNull())
    enough = lambda c: F.when(pairs >= min_window, F.when(~F.isnan(c), c))
    by = x.groupBy(*ASSET).agg(enough(F.corr("value", "prev")).alias("ar1"), enough(F.corr("sq", "prev_sq")).alias("vol"))
    return by.groupBy("factor").agg(
        F.median("ar1").alias("ar1_median"), (F.percentile("ar1", F.lit(0.75)) - F.percentile("ar1", F.lit(0.25))).alias("ar1_iqr"), F.median("vol").alias("vol_cluster")
    )


def rank_autocorrelation(panel: DataFrame) -> DataFrame:
    """(factor, rank_autocorr): the mean over dates of the correlation of ranks with the date before."""
    ranked = panel.select("factor", "date", "asset", F.round("value", 9).alias("value"))
    ranked = ranked.withColumn("r", average_rank(F.col("value"), *DATE))
    ranked = ranked.withColumn("before", F.lag("r").over(Window.partitionBy(*ASSET).orderBy("date")))
    by = ranked.groupBy(*DATE).agg(F.corr("r", "before").alias("c"))
    return by.groupBy("factor").agg(F.avg(F.when(~F.isnan("c"), F.col("c"))).alias("rank_autocorr"))


def cross_sections(panel: DataFrame) -> DataFrame:
    """(factor, skewness_std, kurtosis_std, cs_dispersion, coverage, skew, kurt)."""
    v = F.col("value")
    by = panel.groupBy(*DATE).agg(sample_skew(v).alias("s"), sample_kurtosis(v).alias("k"), F.stddev_samp(v).alias("d"), F.count(v).alias("n"), F.count("*").alias("all"))
    return by.groupBy("factor").agg(
        F.stddev_samp("s").alias("skewness_std"), F.stddev_samp("k").alias("kurtosis_std"), F.avg("d").alias("cs_dispersion"), (F.sum("n") / F.sum("all")).alias("coverage"),
        F.avg("s").alias("skew"), F.avg("k").alias("kurt"),
    )


def divergence(panel: DataFrame, bins: int = 10) -> DataFrame:
    """(factor, js_divergence_mean): Jensen-Shannon divergence of consecutive dates' histograms, bins cut at the factor's quantiles."""
    held = panel.where("value IS NOT NULL").select("factor", "date", "asset", F.round("value", 9).alias("v"))
    cuts = panel_quantiles(held, [k / bins for k in range(1, bins)], "v").select("factor", F.array(*[f"q{k}" for k in range(bins - 1)]).alias("cuts"))
    binned = held.join(cuts, "factor").select("factor", "date", F.size(F.filter("cuts", lambda c: F.round(c, 9) < F.col("v"))).alias("bin"))
    n = F.count("*").cast("double")
    shares = binned.groupBy(*DATE).agg(*[(F.count_if(F.col("bin") == k) / n).alias(f"p{k}") for k in range(bins)])
    w = Window.partitionBy("factor").orderBy("date")
    pairs = shares.select("factor", *[f"p{k}" for k in range(bins)], *[F.lag(f"p{k}").over(w).alias(f"q{k}") for k in range(bins)])

    def part(a, b):
        return F.when(a > 0, a * F.log(2 * a / (a + b))).otherwise(0.0)

    js = sum((part(F.col(f"p{k}"), F.col(f"q{k}")) + part(F.col(f"q{k}"), F.col(f"p{k}")) for k in range(bins)), F.lit(0.0)) / 2
    return pairs.where("q0 IS NOT NULL").groupBy("factor").agg(F.avg(js).alias("js_divergence_mean"))


def fingerprint(panel: DataFrame, min_window: int = 24) -> DataFrame:
    """One row per factor with the thirteen fields."""
    x = panel.select("factor").distinct()
    for part in (persistence(panel, min_window), rank_autocorrelation(panel), cross_sections(panel), divergence(panel)):
        x = x.join(part, "factor", "left")
    a = F.col("ar1_median")
    return x.select(
        "factor",
        a,
        "ar1_iqr",
        "rank_autocorr",
        F.when((a > 0) & (a < 1), -F.log(F.lit(2.0)) / F.log(a)).otherwise(0.0).alias("half_life"),
        "vol_cluster",
        "skewness_std",
        "kurtosis_std",
        "js_divergence_mean",
        (0.5 * a + 0.5 * F.col("rank_autocorr")).alias("sd_score"),
        F.least(F.lit(1.0), 0.5 * F.abs("skew") / SKEW_LIMIT + 0.5 * F.greatest(F.col("kurt"), F.lit(0.0)) / KURT_LIMIT).alias("complexity_need"),
        F.least(F.lit(100.0), a * a / F.nullif(1 - a * a, F.lit(0.0))).alias("snr_estimate"),
        "coverage",
        "cs_dispersion",
    )
