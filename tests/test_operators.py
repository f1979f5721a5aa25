"""Operators against pandas and least squares on panels with gaps and edge cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import classify, decouple, fingerprint, impute, monitor, neutralize, outlier, quantiles, standardize, transform, whiten
from panelwright.operators.volatility import fit_many
from panelwright.plans.errors import ConfigurationError, FactorTypeError, NeutralizationError
from panelwright.plans.steps import Garch
from panelwright.sources import panels, synthetic

SCHEMA = "factor string, date date, asset string, value double"


def wide_to_panel(spark, wide: pd.DataFrame, factor="f"):
    rows = [(factor, d, a, None if pd.isna(v) else float(v)) for d, r in wide.iterrows() for a, v in r.items()]
    return spark.createDataFrame(rows, SCHEMA)


def to_wide(panel) -> pd.DataFrame:
    return panel.select("date", "asset", "value").toPandas().pivot(index="date", columns="asset", values="value").sort_index()


def make(n_dates=40, n_assets=16, gaps=0.1, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n_dates, n_assets)) * rng.uniform(0.5, 3, n_assets)
    x[rng.random(x.shape) < gaps] = np.nan
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n_dates)]
    return pd.DataFrame(x, index=days, columns=[f"A{i:02d}" for i in range(n_assets)])


def check(panel, want: pd.DataFrame, tol=1e-9):
    got = to_wide(panel).reindex(index=want.index, columns=want.columns)
    assert (got.isna() == want.isna()).all().all()
    assert np.nanmax(np.abs(got.to_numpy(float) - want.to_numpy(float))) < tol


@pytest.fixture(scope="module")
def wide():
    x = make()
    x["A03"] = np.nan  # no value at all
    x["A04"] = 2.5  # constant
    return x


@pytest.fixture(scope="module")
def panel(spark, wide):
    return wide_to_panel(spark, wide).cache()


@pytest.fixture(scope="module")
def labels(wide):
    names = {a: f"I{i % 3}" for i, a in enumerate(wide.columns)}
    names["A05"] = None  # known, without a label
    del names["A06"]  # not in the map
    return names


@pytest.fixture(scope="module")
def with_industry(spark, panel, labels):
    return panels.attach_industry(panel, spark.createDataFrame(list(labels.items()), "asset string, industry string")).cache()


def test_imputation(panel, wide):
    check(impute.impute(panel), wide.fillna(wide.median()))
    check(impute.impute(panel, "mean"), wide.fillna(wide.mean()))
    check(impute.impute(panel, "ffill"), wide.ffill())
    check(impute.impute(panel, "constant", 7), wide.fillna(7.0))
    check(impute.impute(impute.impute(panel)), wide.fillna(wide.median()))  # twice is once
    with pytest.raises(ConfigurationError):
        impute.impute(panel, "guess")


def test_tiny_imputation(spark):
    x = pd.DataFrame({"A": [1, np.nan, 3, 4]}, index=[dt.date(2020, 1, d) for d in range(1, 5)])
    assert to_wide(impute.impute(wide_to_panel(spark, x)))["A"].tolist() == [1, 3, 3, 4]


def test_most_frequent_takes_the_smallest_of_ties(spark):
    x = pd.DataFrame({"A": [2, 2, 1, 1, np.nan], "B": [np.nan, 5, 5, 4, 3]}, index=[dt.date(2020, 1, d) for d in range(1, 6)])
    got = to_wide(impute.impute(wide_to_panel(spark, x), "most_frequent"))
    assert got["A"].tolist() == [2, 2, 1, 1, 1] and got["B"].tolist() == [5, 5, 5, 4, 3]


def test_fitted_medians_fill_other_dates(panel, wide):
    early = wide.index[:20]
    check(impute.apply_fills(panel, impute.fit_medians(panel.where(F.col("date") <= early[-1]))), wide.fillna(wide.loc[early].median()))


def test_outliers(panel, wide):
    check(outlier.tame(panel), wide.clip(wide.quantile(0.05), wide.quantile(0.95), axis=1))
    m, s = wide.mean(), wide.std()
    check(outlier.tame(panel, "z_score", threshold=1.5), wide.clip(m - 1.5 * s, m + 1.5 * s, axis=1))
    med = wide.median()
    mad = (wide - med).abs().median() * 1.4826 * 2
    check(outlier.tame(panel, "mad", threshold=2.0), wide.clip(med - mad, med + mad, axis=1))
    flat = wide.stack()
    low, high = flat.quantile(0.01), flat.quantile(0.99)
    check(outlier.tame(panel, "percentile", scope="panel"), wide.clip(low, high))
    with pytest.raises(ConfigurationError):
        outlier.tame(panel, "magic")


@pytest.mark.parametrize("rate", [1, 4, quantiles.RATE])
def test_panel_quantiles(spark, rate):
    rng = np.random.default_rng(5)
    wide = {"normal": rng.normal(size=4000), "heavy": rng.standard_cauchy(size=3000), "hot": np.where(rng.random(3000) < 0.4, 1.0, rng.normal(size=3000)), "one": np.array([2.5]), "same": np.full(900, -3.0)}
    rows = [(f, dt.date(2020, 1, 1) + dt.timedelta(days=k // 50), str(k % 50), float(v)) for f, x in wide.items() for k, v in enumerate(x)]
    rows += [(f, dt.date(2030, 1, 1), "0", None) for f in (*wide, "none")]
    x = spark.createDataFrame(rows, panels.PANEL)
    qs = (0.0, 0.01, 0.25, 0.5, 0.95, 1.0)
    found = {r.factor: list(r[1:]) for r in quantiles.panel_quantiles(x, qs, rate=rate).collect()}
    assert set(found) == set(wide)
    for f, v in wide.items():
        np.testing.assert_allclose(found[f], np.quantile(v, qs), rtol=1e-12, atol=1e-12)


def test_panel_quantiles_part_a_factor(spark):
    x = spark.range(20000).select(F.lit("f").alias("factor"), F.to_date(F.lit("2020-01-01")).alias("date"), F.col("id").cast("string").alias("asset"), F.pow("id", F.lit(2.0)).alias("value"))
    ends = np.array([-1.0, *quantiles._cuts(x.select("factor", F.col("value").alias("v")), 16).first().cuts, 20000.0**2])
    assert len(ends) == quantiles.STRETCHES + 1 and np.diff(np.sqrt(np.maximum(ends, 0))).max() < 20000 / 16
    assert quantiles.panel_quantiles(x, (0.5,), rate=16).first().q0 == (9999.0**2 + 10000.0**2) / 2
    assert quantiles.panel_quantiles(x.limit(0), (0.5,)).count() == 0


@pytest.mark.parametrize("method", ["percentile", "iqr", "mad", "z_score"])
def test_outliers_by_panel(panel, wide, method):
    v = wide.to_numpy()[~np.isnan(wide.to_numpy())]
    q, med = np.quantile(v, [0.01, 0.25, 0.75, 0.99]), np.median(v)
    mad, iqr, sd = 2 * 1.4826 * np.median(np.abs(v - med)), 1.5 * (q[2] - q[1]), 2 * v.std(ddof=1)
    low, high = {"percentile": (q[0], q[3]), "iqr": (q[1] - iqr, q[2] + iqr), "mad": (med - mad, med + mad), "z_score": (v.mean() - sd, v.mean() + sd)}[method]
    out = outlier.tame(panel, method, threshold=2.0, scope="panel").toPandas()
    np.testing.assert_allclose(np.sort(out.value.dropna()), np.sort(np.clip(v, low, high)), rtol=1e-9)
    assert len(out) == wide.size


def test_sigma_bounds_are_those_of_fit(panel, wide):
    early = wide.iloc[:20]
    fit = outlier.fit_sigma_bounds(panel.where(F.col("date") <= early.index[-1]), 1.0)
    check(outlier.apply_bounds(panel, fit), wide.clip(early.mean() - early.std(), early.mean() + early.std(), axis=1))


def test_standardization(panel, wide):
    sd = wide.std()
    check(standardize.standardize(panel), (wide - wide.mean()) / sd.where(sd != 0, 1))
    low, high = wide.min(), wide.max()
    check(standardize.standardize(panel, "min_max"), ((wide - low) / (high - low).where(high > low, 1)))
    q = wide.quantile(0.75) - wide.quantile(0.25)
    check(standardize.standardize(panel, "robust"), (wide - wide.median()) / q.where(q != 0, 1))
    ranks = (wide.rank(axis=1, method="min") - 1).div(wide.notna().sum(axis=1) - 1, axis=0)
    check(standardize.standardize(panel, "rank"), ranks)
    with pytest.raises(ConfigurationError):
        standardize.standardize(panel, "odd")


def test_moments(panel, wide):
    got = transform.asset_moments(panel).toPandas().set_index("asset")
    for name, want in (("skew", wide.skew()), ("kurt", wide.kurt()), ("std", wide.std()), ("median", wide.median())):
        a, b = got[name].astype(float).reindex(wide.columns), want
        assert (a.isna() == b.isna()).all() and np.nanmax(np.abs(a - b)) < 1e-9, name


def residuals(row: pd.Series, labels: dict, filtered: bool) -> pd.Series:
    """The rules of a date, with least squares on dummies."""
    out, y = pd.Series(0.0, index=row.index), row.dropna()
    if filtered:
        y = y[[labels.get(a) is not None for a in y.index]]
        g = pd.Series({a: labels[a] for a in y.index}, dtype=object)
        if len(y) < 10 or g.nunique() < 2:
            return out
        y = y[g.isin([k for k, n in g.value_counts().items() if n >= 5])]
        g = g[y.index]
    else:
        if len(y) < 10:
            return out
        y = y[[a in labels for a in y.index]]
        if len(y) < 5:
            return out
        g = pd.Series({a: labels[a] for a in y.index}, dtype=object)
        if g.nunique() < 2:
            out[y.index] = y
            return out
    if not len(y):
        return out
    x = np.column_stack([np.ones(len(y)), pd.get_dummies(g, drop_first=True).to_numpy(float)])
    out[y.index] = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return out


@pytest.mark.parametrize("method", ["ols", "filtered"])
def test_neutralization_is_least_squares(with_industry, wide, labels, method):
    check(neutralize.neutralize(with_industry, method), wide.apply(residuals, axis=1, labels=labels, filtered=method == "filtered"))


@pytest.mark.parametrize("present", [4, 9, 10])
@pytest.mark.parametrize("method", ["ols", "filtered"])
def test_date_gates_and_single_industry(spark, method, present):
    x = make(3, 12, 0)
    x.iloc[0, present:] = np.nan
    for names in ({a: "one" for a in x.columns}, {a: "one" if i % 2 else "two" for i, a in enumerate(x.columns)}, {a: "one" for a in list(x.columns)[:4]}):
        got = neutralize.neutralize(panels.attach_industry(wide_to_panel(spark, x), spark.createDataFrame(list(names.items()), "asset string, industry string")), method)
        check(got, x.apply(residuals, axis=1, labels=names, filtered=method == "filtered"))


def test_size_neutralization_is_least_squares(spark, with_industry, wide, labels):
    rng = np.random.default_rng(3)
    size = pd.DataFrame(rng.lognormal(10, 1, wide.shape), index=wide.index, columns=wide.columns)
    rows = [(d, a, float(v)) for d, r in size.iterrows() for a, v in r.items()]
    x = panels.attach_mcap(with_industry, spark.createDataFrame(rows, "date date, asset string, mcap double"))
    got = to_wide(neutralize.neutralize(x, "industry_mcap"))
    for d in wide.index:
        y = wide.loc[d].dropna()
        y = y[[a in labels for a in y.index]]
        g = pd.Series({a: labels[a] for a in y.index}).fillna("I0")
        m = np.column_stack([pd.get_dummies(g).to_numpy(float), np.log(size.loc[d, y.index])])
        assert np.abs(got.loc[d, y.index] - (y - m @ np.linalg.lstsq(m, y, rcond=None)[0])).max() < 1e-9
    w = to_wide(neutralize.neutralize(x, "wls"))
    y = wide.iloc[0].dropna()
    group = [a for a in y.index if labels.get(a) == "I1"]
    assert abs((w.iloc[0][group] * size.iloc[0][group]).sum()) < 1e-5
    with pytest.raises(NeutralizationError):
        neutralize.neutralize(with_industry, "mcap")
    with pytest.raises(NeutralizationError):
        neutralize.neutralize(with_industry.drop("industry"))


def test_zero_fill_can_be_left_out(with_industry):
    assert neutralize.neutralize(with_industry, zero_fill=False).where("asset = 'A06' AND value IS NOT NULL").isEmpty()


def test_ridge_shrinks_groups(with_industry):
    strong, none = (neutralize.neutralize(with_industry, "ridge", alpha=a) for a in (1e12, 0.0))
    check(none, to_wide(neutralize.neutralize(with_industry, "ols")), 1e-6)
    assert abs(to_wide(strong).drop(columns=["A06"]).iloc[0].sum()) < 1e-6


def test_rolling(panel, wide):
    sd = wide.rolling(20, min_periods=10).std()
    got = to_wide(whiten.rolling_whiten(panel)).reindex(columns=wide.columns).drop(columns="A04")
    want = (wide / sd.replace(0, np.nan)).drop(columns="A04")
    assert (got.isna() == want.isna()).all().all() and np.nanmax(np.abs(got - want)) < 1e-9


def test_garch(spark):
    rng = np.random.default_rng(0)
    n, e, var = 3000, np.zeros(3000), np.ones(3000)
    for t in range(1, n):
        var[t] = 0.1 + 0.2 * e[t - 1] ** 2 + 0.7 * var[t - 1]
        e[t] = np.sqrt(var[t]) * rng.standard_normal()
    z, fit = whiten.fit_garch(e + 5)
    assert abs(fit["alpha"][0] - 0.2) < 0.06 and abs(fit["beta"][0] - 0.7) < 0.1 and abs(z.std() - 1) < 0.05
    x = make(60, 2, 0.0)
    x.iloc[:, 1] = np.where(np.arange(60) < 20, x.iloc[:, 1], np.nan)  # too short
    x["C"] = 1.0  # constant
    got = to_wide(whiten.garch_whiten(wide_to_panel(spark, x)))
    assert (got.iloc[:, 1:].fillna(9) == x.iloc[:, 1:].fillna(9)).all().all()
    assert abs(got.iloc[:, 0].std() - 1) < 0.2
    stats = Garch("garch", vol="GJR-Garch", p=2).get_stats(wide_to_panel(spark, x))
    assert (stats["fitted_models"], stats["skipped_columns"]) == (1, 2) and np.isfinite(stats["average_aic"])
    own = to_wide(whiten.garch_whiten(wide_to_panel(spark, x), model=lambda s: (s * 0 + 7, 1.0)))
    assert (own.iloc[:, 0] == 7).all() and (own["C"] == 7).all() and (own.iloc[:, 1].dropna() == x.iloc[:, 1].dropna()).all()
    for bad in ({"vol": "Arch"}, {"p": 6}, {"q": -1}, {"p": 0, "q": 0}):
        with pytest.raises(ConfigurationError):
            whiten.garch_whiten(wide_to_panel(spark, x), **bad)


def _likelihood(x, vol, mean, omega, alpha, gamma, beta):
    """Plain recursion of one series, value by value."""
    e0 = x - x.mean()
    w = 0.94 ** np.arange(min(75, len(x)))
    back = float((w * e0[: len(w)] ** 2).sum() / w.sum())
    e, var, total = x - mean, [], 0.0
    for t in range(len(x)):
        if vol == "EGarch":
            v = omega
            for i, a in enumerate(alpha, 1):
                v += a * (abs(e[t - i]) / np.sqrt(var[t - i]) - np.sqrt(2 / np.pi)) if t >= i else 0.0
            for j, b in enumerate(beta, 1):
                v += b * np.log(var[t - j] if t >= j else back)
            v = np.exp(v)
        else:
            v = omega
            for i, a in enumerate(alpha, 1):
                v += a * (e[t - i] ** 2 if t >= i else back)
            for j, b in enumerate(beta, 1):
                v += b * (var[t - j] if t >= j else back)
            v += gamma * ((e[t - 1] ** 2 if e[t - 1] < 0 else 0.0) if t else back / 2)
        var.append(v)
        total += -0.5 * (np.log(2 * np.pi * v) + e[t] ** 2 / v)
    return total, e / np.sqrt(var)


@pytest.mark.parametrize(
    "vol,p,q,slack", [("Garch", 1, 1, 1e-3), ("Garch", 2, 1, 1e-3), ("Garch", 1, 0, 1e-3), ("GJR-Garch", 1, 1, 1e-3), ("EGarch", 1, 1, 1e-3), ("EGarch", 2, 2, 0.05)]
)
def test_volatility_against_a_plain_maximiser(vol, p, q, slack):
    """Values agree with a plain recursion, and a random search near and far from the fit finds nothing better (EGarch with more lags: by 0.05)."""
    rng = np.random.default_rng(3)
    series = [rng.standard_normal(n) * (1 + np.sin(np.arange(n) / 9) ** 2) * 4 + 2 for n in (60, 150)]
    names = ("mean", "omega", "alpha", "gamma", "beta")
    for x, fit in zip(series, fit_many(series, vol, p, q)):
        best, z = _likelihood(x, vol, *[fit[k] for k in names])
        assert np.isfinite(best)
        k = 2 + p + q + (vol == "GJR-Garch")
        assert abs(2 * k - 2 * best - fit["aic"]) < 1e-6 and np.abs(z - fit["z"]).max() < 1e-6
        for trial in range(300):
            size = 10.0 ** -rng.integers(1, 4)
            shift = lambda v: np.asarray(v) * (1 + size * rng.standard_normal(np.shape(v))) + size * 0.1 * rng.standard_normal(np.shape(v))  # noqa: B023, E731
            alpha, beta, gamma = shift(fit["alpha"]), shift(fit["beta"]), float(shift(fit["gamma"])) if vol == "GJR-Garch" else 0.0
            omega = float(shift(fit["omega"]))
            if vol != "EGarch":
                alpha, beta, omega = np.maximum(alpha, 0), np.maximum(beta, 0), max(omega, 1e-9)
                gamma = max(gamma, -alpha[0])
                if alpha.sum() + beta.sum() + gamma / 2 >= 0.9995:
                    continue
            elif abs(beta.sum()) >= 0.9995:
                continue
            with np.errstate(all="ignore"):  # a variance that runs away has no likelihood
                other, _ = _likelihood(x, vol, float(shift(fit["mean"])), omega, alpha, gamma, beta)
            assert not other > best + slack


def test_volatility_of_odd_series():
    """Empty, constant, short, huge and tiny series, and repeated ones, which get equal fits."""
    x = np.random.default_rng(0).standard_normal(80)
    fits = fit_many([np.array([]), np.ones(60), np.array([1.0]), x, x, x * 1e12, x * 1e-12, np.array([1.0, 2.0])], "Garch", 1, 1)
    assert fits[:3] == [None] * 3 and all(np.isfinite(f["z"]).all() for f in fits[3:])
    assert fits[3]["aic"] == fits[4]["aic"] and np.abs(fits[5]["z"] - fits[3]["z"]).max() < 1e-3 and np.abs(fits[6]["z"] - fits[3]["z"]).max() < 1e-3


def test_power_curves(spark):
    x = make(50, 4, 0).abs() + 0.1
    panel = wide_to_panel(spark, np.exp(x))
    power = transform.fit_power(panel, "box_cox").first().power
    v = np.exp(x).to_numpy().ravel()

    def like(p):
        y = np.log(v) if p == 0 else (v**p - 1) / p
        return round(-len(v) / 2 * np.log(y.var()) + (p - 1) * np.log(v).sum(), 6)

    assert power == max((g / 10 for g in transform.GRID), key=lambda p: (like(p), -abs(p), -p))
    negative = wide_to_panel(spark, x - 3)
    check(transform.reshape(negative, "none"), x - 3)
    assert transform.reshape(negative, "yeo_johnson").where("value IS NULL").isEmpty()
    assert transform.reshape(negative, "box_cox").where("value IS NULL").isEmpty()  # what is not positive stays


def test_gate(spark):
    calm, wild = make(60, 6, 0), make(60, 6, 0) ** 7
    both = panels.combine(wide_to_panel(spark, calm, "calm"), wide_to_panel(spark, wild, "wild"))
    assert {r.factor: r.needed for r in transform.needs_transform(both).collect()} == {"calm": False, "wild": True}


def test_autoregression(spark):
    x = synthetic.autoregressive(spark, "mixed", 400, 3)
    fit = decouple.ar_fit(x, 4, "bic").collect()
    for r in fit:
        v = x.where(F.col("asset") == r.asset).orderBy("date").toPandas()["value"].to_numpy()
        c = v - v.mean()
        g = np.array([(c[k:] * c[: len(c) - k]).sum() / len(c) for k in range(6)])
        if r.p:
            phi = np.linalg.solve([[g[abs(i - j)] for j in range(r.p)] for i in range(r.p)], g[1 : r.p + 1])
            assert np.abs(phi - r.phi).max() < 1e-9
    left = decouple.ar_residual(x, 4)
    by = fingerprint.persistence(left).first()
    assert abs(by.ar1_median) < 0.15
    half = decouple.ar_residual(x, 4, strength=0.5)
    assert fingerprint.persistence(half).first().ar1_median > by.ar1_median
    with pytest.raises(ConfigurationError):
        decouple.ar_fit(x, 2, "none")


def test_fingerprints_and_classes(spark):
    x = panels.combine(*(synthetic.autoregressive(spark, k, 120, 40) for k in ("static", "dynamic", "mixed")))
    prints = fingerprint.fingerprint(x).cache()
    got = {r.factor: r for r in prints.collect()}
    assert prints.columns == ["factor", *[f for f in prints.columns[1:]]] and set(prints.columns[1:]) == set(fingerprint.FIELDS)
    assert got["static"].ar1_median > got["mixed"].ar1_median > got["dynamic"].ar1_median
    kinds = {r.factor: r.primary_type for r in classify.classify(prints).collect()}
    assert kinds == {"static": "STATIC", "dynamic": "DYNAMIC", "mixed": "MIXED"}


def test_fusion_zones(spark):
    prints = spark.createDataFrame([("a", 0.9, 0.9, 0.0), ("b", 0.9, 0.9, 1.0), ("c", 0.9, 0.9, 1.0), ("d", 0.9, 0.9, 1.0), ("e", 0.9, 0.9, 1.0)], "factor string, ar1_median double, rank_autocorr double, coverage double")
    told = spark.createDataFrame([("a", "momentum", 0), ("b", "momentum", 0), ("c", "momentum", 24), ("d", "book value", 24), ("e", "???", 0)], "factor string, description string, data_months int")
    got = {r.factor: (r.primary_type, r.conflict_reason) for r in classify.fuse(classify.classify(prints), prints, told, told).collect()}
    assert got == {"a": ("DYNAMIC", "SEMANTIC_OVERRIDE"), "b": ("MIXED", "DOWNGRADED_TO_MIXED"), "c": ("STATIC", "HUMAN_REVIEW"), "d": ("STATIC", None), "e": ("STATIC", None)}


def test_history(spark):
    rows = [("a", dt.date(2020, 1, 1), "STATIC", 0.9), ("a", dt.date(2021, 1, 1), "STATIC", 0.9), ("a", dt.date(2022, 1, 1), "DYNAMIC", 0.1), ("b", dt.date(2020, 1, 1), "MIXED", 0.5)]
    h = spark.createDataFrame(rows, "factor string, as_of date, primary_type string, ar1_median double")
    assert [(r.factor, r.level) for r in monitor.migrations(h).collect()] == [("a", "CRITICAL")]
    assert {r.factor: round(r.stability, 3) for r in monitor.stability(h).collect()} == {"a": 0.667, "b": 1.0}
    assert {r.factor: r.primary_type for r in monitor.latest(h).collect()} == {"a": "DYNAMIC", "b": "MIXED"}
    w = monitor.transition_weights(h.where("factor = 'b'")).first()
    assert abs(w.static + w.mixed + w.dynamic - 1) < 1e-12 and w.mixed > w.static


def test_panel_boundary(spark, tmp_path):
    bad = spark.createDataFrame([("x", "y")], "date string, asset string")
    with pytest.raises(FactorTypeError):
        panels.panel_of(bad, "f")
    with pytest.raises(FactorTypeError):
        panels.panel_of(bad.selectExpr("date", "asset", "asset AS value"), "f")
    x = spark.createDataFrame([("2020-01-01", "a", float("nan")), ("2020-01-02", "b", 1.0)], "date string, asset string, value double")
    cells = panels.panel_of(x, "f")
    assert cells.where("value IS NULL").count() == 1
    assert panels.dense(cells).count() == 4
    panels.write(cells, str(tmp_path / "p"))
    assert panels.panel_of(spark.read.parquet(str(tmp_path / "p")), F.col("factor")).count() == 2
    cells.drop("factor").write.option("header", True).csv(str(tmp_path / "c"))
    assert sorted(r.value is None for r in panels.read(spark, str(tmp_path / "c"), "f", "csv").collect()) == [False, True]


def test_wide_round_trip(spark, panel, wide):
    w = panels.pivot_wide(panel, list(wide.columns)).drop("factor")
    check(panels.unpivot_long(w, "f"), wide)


def test_synthetic_panel(spark):
    x = synthetic.noisy_panel(spark, 100, 50, 0.1)
    p = panels.null_profile(x).first()
    assert (p.n_dates, p.n_assets, p.n_cells) == (100, 50, 5000) and 0.07 < p.missing_rate < 0.13
    assert x.exceptAll(synthetic.noisy_panel(spark, 100, 50, 0.1)).isEmpty()


def test_empty_panel(spark):
    e = spark.createDataFrame([], SCHEMA + ", industry string, known boolean, mcap double")
    for f in (impute.impute, outlier.tame, standardize.standardize, neutralize.neutralize, whiten.rolling_whiten, whiten.garch_whiten, transform.reshape, decouple.ar_residual):
        assert f(e).isEmpty()


def test_wide_frames_in_blocks_keep_all_cells(spark):
    rows = [("f", d, a, v) for d in (dt.date(2020, 1, 1), dt.date(2020, 2, 1)) for a, v in (("a", 1.0), ("b", None), (None, 3.0), ("a", 1.0), ("c", 4.0))]
    panel = spark.createDataFrame(rows, panels.PANEL)
    wide = panels.pivot_blocks(panel, block=2)
    assert wide.select("block").distinct().count() == 2
    assert sorted(map(repr, panels.unpivot_blocks(wide).collect())) == sorted(map(repr, panel.collect()))
    assert panels.pivot_blocks(panel.limit(0)).count() == 0
