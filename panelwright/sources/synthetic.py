"""Generated panels for demonstrations and tests, made in parallel from a seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def noisy_panel(spark: SparkSession, dates: int = 100, assets: int = 50, missing: float = 0.1, seed: int = 42, factor: str = "sample") -> DataFrame:
    """Heavy-tailed values around 10 (Student t of 3 degrees, doubled), 2 % outliers of 20 to 40 either way, some missing.

    Built from ``spark.range`` and column generators, so any size is made where it is used.
    """
    n = F.col("id")
    base = spark.range(dates * assets).select(
        F.lit(factor).alias("factor"), F.date_add(F.lit("2020-01-01").cast("date"), (n / assets).cast("int")).alias("date"), F.format_string("STOCK_%04d", n % assets).alias("asset"),
        F.randn(seed).alias("z"), (F.pow(F.randn(seed + 1), 2) + F.pow(F.randn(seed + 2), 2) + F.pow(F.randn(seed + 3), 2)).alias("chi"),
        F.rand(seed + 4).alias("u"), F.rand(seed + 5).alias("far"), F.rand(seed + 6).alias("gap"),
    )
    t3 = F.col("z") / F.sqrt(F.col("chi") / 3)
    jump = F.when(F.col("u") < 0.01, 20 + 20 * F.col("far")).when(F.col("u") < 0.02, -20 - 20 * F.col("far")).otherwise(0.0)
    return base.select("factor", "date", "asset", F.when(F.col("gap") >= missing, 2 * t3 + 10 + jump).alias("value"))


def autoregressive(spark: SparkSession, kind: str, dates: int = 60, assets: int = 50, seed: int = 42) -> DataFrame:
    """A slow (0.95), fast (-0.1) or middling (0.6) autoregressive factor, as a panel named by its kind."""
    phi, sigma = {"static": (0.95, 0.3), "dynamic": (-0.1, 0.9), "mixed": (0.6, 0.8)}[kind]
    rng = np.random.default_rng(seed)
    x = np.zeros((dates, assets))
    x[0] = rng.lognormal(0, 1, assets) if kind == "static" else rng.standard_normal(assets)
    for t in range(1, dates):
        x[t] = phi * x[t - 1] + sigma * rng.standard_normal(assets)
    when = pd.date_range("2020-01-31", periods=dates, freq="ME").date
    rows = pd.DataFrame({"factor": kind, "date": np.repeat(when, assets), "asset": [f"STOCK_{i:04d}" for i in range(assets)] * dates, "value": x.ravel()})
    return spark.createDataFrame(rows, "factor string, date date, asset string, value double")
