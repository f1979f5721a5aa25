"""Whitening through time: rolling deviation, and conditional volatility."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ASSET
from ..plans.errors import ConfigurationError
from .volatility import KINDS, fit_many

WINDOW, MIN_SEEN, MIN_OBS = 20, 10, 50
#: Orders that configurations may ask for.
ORDERS = range(6)

#: A model of one's own: a series without missing values to residuals over deviations and an AIC, or None to leave it.
VolatilityModel = Callable[[np.ndarray], tuple[np.ndarray, float] | None]


def rolling_whiten(panel: DataFrame, window: int = WINDOW, min_seen: int = MIN_SEEN) -> DataFrame:
    """Values over their rolling deviation: so many rows of the dense panel, of which some must hold values; a 0 deviation gives null."""
    w = Window.partitionBy(*ASSET).orderBy("date").rowsBetween(1 - window, 0)
    sd = F.when(F.count("value").over(w) >= min_seen, F.stddev_samp("value").over(w))
    return panel.withColumn("value", F.col("value") / F.nullif(sd, F.lit(0.0)))


def fit_garch(x: np.ndarray, vol: str = "Garch", p: int = 1, q: int = 1) -> tuple[np.ndarray, dict]:
    """One series' residuals over conditional deviations, and its fit; NaN where it is constant."""
    fit = fit_many([np.asarray(x, float)], vol, p, q)[0]
    if fit is None:
        return np.full(len(x), np.nan), {"alpha": [0.0] * p, "beta": [0.0] * q, "aic": np.nan}
    return fit.pop("z"), fit


def _fitted(vol: str, p: int, q: int, model: VolatilityModel | None) -> Callable:
    """A function of batches of series, which it fits together, to their residuals and AICs; null where there is no fit."""

    def fit(series: pd.Series) -> pd.DataFrame:
        values = [np.asarray([] if s is None else s, float) for s in series]
        held = [~np.isnan(v) for v in values]
        dense = [v[h] for v, h in zip(values, held)]
        if model is None:
            fits = [f and (f["z"], f["aic"]) for f in fit_many(dense, vol, p, q)]
        else:
            fits = [model(d) if len(d) else None for d in dense]
        z, aic = [], []
        for v, h, f in zip(values, held, fits):
            out = np.full(len(v), np.nan)
            if f is not None:
                out[h] = f[0]
            z.append(None if f is None or np.isnan(out).all() else out)
            aic.append(None if z[-1] is None else float(f[1]))
        return pd.DataFrame({"z": pd.Series(z, dtype=object), "aic": pd.Series(aic, dtype=float)})

    return F.pandas_udf(fit, "z array<double>, aic double")


def garch_whiten(
    panel: DataFrame, vol: str = "Garch", p: int = 1, q: int = 1, min_obs: int = MIN_OBS, with_aic: bool = False, model: VolatilityModel | None = None
) -> DataFrame:
    """Residuals over conditional volatility, per asset; an asset with too few values, or a constant one, stays as it is.

    ``p`` counts lags of the squared residual, ``q`` those of the variance; ``vol`` is
    Garch, EGarch or GJR-Garch (with one asymmetric lag). ``model`` replaces the fit.

    The recursion is sequential in time. Each asset's values are one array, and Python
    sees batches of arrays, fitted together; all other columns stay in the JVM. One
    asset's rows must fit a row.
    """
    if model is None and (vol not in KINDS or p not in ORDERS or q not in ORDERS or p == q == 0):
        raise ConfigurationError("no such volatility model", context={"vol": vol, "p": p, "q": q, "known": KINDS})
    rest = [c for c in panel.columns if c not in ASSET and c != "date"]
    by = panel.groupBy(*ASSET).agg(F.array_sort(F.collect_list(F.struct("date", *rest))).alias("rows"))
    values = F.transform("rows", lambda r: r["value"])
    enough = F.size(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))) >= min_obs
    by = by.withColumn("fit", _fitted(vol, p, q, model)(F.when(enough, values)))
    z = F.coalesce(F.col("fit.z"), F.array().cast("array<double>"))
    new = F.zip_with("rows", z, lambda r, v: r.withField("value", F.coalesce(F.when(~F.isnan(v), v), r["value"])))
    out = by.select(*ASSET, F.col("fit.aic").alias("aic"), F.explode(new).alias("row"))
    return out.select(*[c if c in ASSET else F.col("row")[c].alias(c) for c in panel.columns], *["aic"] * with_aic)
