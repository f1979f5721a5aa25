"""The registered queries in DuckDB SQL, put together from one statement per operator.

A step is a function from a relation's name to a SELECT with the same columns, so
chains are common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

A = "PARTITION BY factor, asset"
D = "PARTITION BY factor, date"
Step = Callable[[str], str]


def supplier_cells(factor: str, value: str) -> str:
    return (
        f"SELECT '{factor}' AS factor, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS asset, {value} AS value FROM lineitem GROUP BY ALL"
    )


INDUSTRY = "SELECT CAST(s_suppkey AS VARCHAR) AS asset, CAST(n_regionkey AS VARCHAR) AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def supplier_month(factor: str = "discount", value: str = "avg(l_discount)") -> str:
    return f"""SELECT '{factor}' AS factor, d.date, i.asset, c.value, i.industry, true AS known, m.mcap
FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem) d CROSS JOIN ({INDUSTRY}) i
LEFT JOIN ({supplier_cells(factor, value)}) c ON c.date = d.date AND c.asset = i.asset
LEFT JOIN (SELECT date, asset, value AS mcap FROM ({supplier_cells('m', 'sum(l_extendedprice)')})) m ON m.date = d.date AND m.asset = i.asset"""


USER_DAY = """SELECT 'event_value' AS factor, d.date, a.asset, c.value, i.c_mktsegment AS industry, i.c_custkey IS NOT NULL AS known, CAST(NULL AS DOUBLE) AS mcap
FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) d CROSS JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS asset FROM events) a
LEFT JOIN (SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS asset, avg(value) AS value FROM events GROUP BY ALL) c ON c.date = d.date AND c.asset = a.asset
LEFT JOIN customer i ON CAST(i.c_custkey AS VARCHAR) = a.asset"""


def ctes(base: str, *steps: Step) -> tuple[str, str]:
    """(common table expressions, name of the last)."""
    parts = [f"s0 AS ({base})"]
    for k, step in enumerate(steps):
        parts.append(f"s{k + 1} AS ({step(f's{k}')})")
    return ",\n".join(parts), f"s{len(steps)}"


def chain(base: str, *steps: Step) -> str:
    parts, last = ctes(base, *steps)
    return f"WITH {parts}\nSELECT factor, date, asset, round(value, 6) + 0.0 AS value FROM {last}"


def replace(expression: str, **more: str) -> Step:
    """A new value, from expressions named beforehand."""
    extra = ", ".join(f"{e} AS {n}" for n, e in more.items())
    inner = f"(SELECT *, {extra} FROM {{}})" if extra else "{}"
    drop = f"EXCLUDE ({', '.join(more)}) " if more else ""
    return lambda src: f"SELECT * {drop}REPLACE (({expression}) AS value) FROM {inner.format(src)}"


def clip(low: str, high: str) -> str:
    return f"CASE WHEN value IS NOT NULL THEN least(greatest(value, {low}), {high}) END"


median_fill = replace(f"coalesce(value, median(value) OVER ({A}))")
mean_fill = replace(f"coalesce(value, avg(value) OVER ({A}))")
zero_fill = replace("coalesce(value, 0.0)")
date_fill = replace(f"coalesce(value, avg(value) OVER ({D}))")
PAST = f"last_value(value IGNORE NULLS) OVER ({A} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ffill = replace(PAST)
hierarchical = replace(f"coalesce({PAST}, avg(value) OVER ({D}, industry), avg(value) OVER ({D}), median(value) OVER ({A}))")
winsorize = replace(clip(f"quantile_cont(value, 0.05) OVER ({A})", f"quantile_cont(value, 0.95) OVER ({A})"))
zscore = replace("(value - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END", m=f"avg(value) OVER ({A})", sd=f"stddev_samp(value) OVER ({A})")


def most_frequent(src: str) -> str:
    return f"""SELECT s.* REPLACE (coalesce(s.value, m.v) AS value) FROM {src} s LEFT JOIN (
  SELECT factor, asset, value AS v FROM {src} WHERE value IS NOT NULL GROUP BY factor, asset, value QUALIFY row_number() OVER ({A} ORDER BY count(*) DESC, value) = 1) m
  ON m.factor = s.factor AND m.asset = s.asset"""


def fitted_medians(src: str) -> str:
    return f"""SELECT s.* REPLACE (coalesce(s.value, m.v) AS value) FROM {src} s LEFT JOIN (
  SELECT factor, asset, median(value) AS v FROM {src} WHERE date < DATE '1996-01-01' GROUP BY ALL) m ON m.factor = s.factor AND m.asset = s.asset"""


def sigma_clip(where: str = "true", k: str = "3") -> Step:
    return lambda src: f"""SELECT s.* REPLACE ({clip('b.lo', 'b.hi').replace('value', 's.value')} AS value) FROM {src} s LEFT JOIN (
  SELECT factor, asset, avg(value) - {k} * stddev_samp(value) AS lo, avg(value) + {k} * stddev_samp(value) AS hi FROM {src} WHERE {where} GROUP BY ALL) b
  ON b.factor = s.factor AND b.asset = s.asset"""


def mad(part: str, k: float, new: str) -> Step:
    def step(src: str) -> str:
        return f"""SELECT * EXCLUDE (med, mad) REPLACE (({new}) AS value) FROM (
  SELECT *, {k} * 1.4826 * median(abs(value - med)) OVER ({part}) AS mad FROM (SELECT *, median(value) OVER ({part}) AS med FROM {src}))"""

    return step


MAD_CLIP = clip("med - mad", "med + mad")
SIGMOID = "CASE WHEN mad > 0 THEN med + mad * tanh((value - med) / mad) ELSE value END"
NEUTRAL = f"""SELECT *, count(value) OVER ({D}) AS n_date, sum(CAST(ok AS INT)) OVER ({D}) AS n_common, min(CASE WHEN ok THEN industry END) OVER ({D}) AS base,
  max(CASE WHEN ok THEN industry END) OVER ({D}) AS top FROM (SELECT *, value IS NOT NULL AND known AS ok FROM {{}})"""
GROUPED = f"SELECT *, CASE WHEN ok THEN coalesce(industry, base) END AS g, ok AND n_date >= 10 AND n_common >= 5 AS use FROM ({NEUTRAL})"
EXTRA = "ok, n_date, n_common, base, top, g, use"


def neutral(residual: str) -> Step:
    return lambda src: f"SELECT * EXCLUDE ({EXTRA}) REPLACE (coalesce(CASE WHEN use THEN {residual} END, 0.0) AS value) FROM ({GROUPED.format(src)})"


industry = neutral(f"CASE WHEN base < top THEN value - avg(value) OVER ({D}, g) ELSE value END")
ridge = neutral(f"value - avg(value) OVER ({D}, use) - count(value) OVER ({D}, g) / (count(value) OVER ({D}, g) + 2.0) * (avg(value) OVER ({D}, g) - avg(value) OVER ({D}, use))")
wls = neutral(f"value - sum(value * CASE WHEN mcap > 0 THEN mcap END) OVER ({D}, g) / sum(CASE WHEN value IS NOT NULL AND mcap > 0 THEN mcap END) OVER ({D}, g)")


def sized(part: str) -> Step:
    def step(src: str) -> str:
        return f"""SELECT * EXCLUDE ({EXTRA}, lx, y, x) REPLACE (coalesce(CASE WHEN use THEN y - coalesce(sum(x * y) OVER ({D}, use) / nullif(sum(x * x) OVER ({D}, use), 0), 0) * x END, 0.0) AS value)
FROM (SELECT *, value - avg(value) OVER ({part}) AS y, lx - avg(lx) OVER ({part}) AS x
FROM (SELECT * REPLACE (use AND lx IS NOT NULL AS use) FROM (SELECT *, CASE WHEN mcap > 0 THEN ln(mcap) END AS lx FROM ({GROUPED.format(src)}))))"""

    return step


def filtered(src: str) -> str:
    return f"""SELECT * EXCLUDE (g, n, lo, hi, ng) REPLACE (coalesce(CASE WHEN g IS NOT NULL AND n >= 10 AND lo < hi AND ng >= 5 THEN value - avg(value) OVER ({D}, g) END, 0.0) AS value)
FROM (SELECT *, count(g) OVER ({D}) AS n, min(g) OVER ({D}) AS lo, max(g) OVER ({D}) AS hi, count(g) OVER ({D}, g) AS ng
FROM (SELECT *, CASE WHEN value IS NOT NULL THEN industry END AS g FROM {src}))"""


def index(src: str) -> str:
    return f"""SELECT * EXCLUDE (m, hm) REPLACE (value - avg(value) OVER ({A}) - coalesce(covar_pop(value, m) OVER ({A}) / nullif(var_pop(hm) OVER ({A}), 0), 0) * (m - avg(hm) OVER ({A})) AS value)
FROM (SELECT *, CASE WHEN value IS NOT NULL THEN m END AS hm FROM (SELECT *, avg(value) OVER ({D}) AS m FROM {src}))"""


def power(kind: str) -> Step:
    yj = """CASE WHEN value >= 0 THEN CASE WHEN l = 0 THEN ln(1 + value) ELSE (pow(value + 1, l) - 1) / l END
  WHEN value < 0 THEN CASE WHEN l = 2 THEN -ln(1 - value) ELSE -(pow(1 - value, 2 - l) - 1) / (2 - l) END END"""
    bc = "CASE WHEN value > 0 THEN CASE WHEN l = 0 THEN ln(value) ELSE (pow(value, l) - 1) / l END END"
    y, j = (yj, "sign(value) * ln(1 + abs(value))") if kind == "yeo_johnson" else (bc, "CASE WHEN value > 0 THEN ln(value) END")
    return lambda src: f"""SELECT s.factor, s.date, s.asset, coalesce({y}, value) AS value, industry, known, mcap FROM {src} s LEFT JOIN (
  SELECT factor, l FROM (SELECT factor, l, count(j) AS n, var_pop(y) AS v, sum(j) AS sj
    FROM (SELECT factor, l, {y} AS y, {j} AS j FROM {src} CROSS JOIN (SELECT unnest(range(-20, 21)) / 10.0 AS l)) GROUP BY factor, l)
  WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY factor ORDER BY round(-n / 2.0 * ln(v) + (l - 1) * sj, 6) DESC, abs(l), l) = 1) p ON p.factor = s.factor"""


percent_rank = lambda part, held="value IS NULL": (
    replace(f"CASE WHEN value IS NOT NULL THEN percent_rank() OVER (PARTITION BY {part}, {held} ORDER BY round(value, 9)) END")
)
ROLL = f"{A} ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
rolling = replace(f"value / nullif(CASE WHEN count(value) OVER ({ROLL}) >= 10 THEN stddev_samp(value) OVER ({ROLL}) END, 0)")
MOMENTS = "CASE WHEN count(value) >= 3 THEN coalesce({skew}, 0.0) END AS skew, CASE WHEN count(value) >= 4 THEN coalesce({kurt}, 0.0) END AS kurt"


def moments(src: str, by: str = "factor, asset") -> str:
    m = "CASE WHEN count(value) >= 3 AND var_pop(value) > 0 THEN skewness(value) WHEN count(value) >= 3 THEN 0.0 END AS skew, CASE WHEN count(value) >= 4 AND var_pop(value) > 0 THEN kurtosis(value) WHEN count(value) >= 4 THEN 0.0 END AS kurt"
    return f"""SELECT {by}, count(value) AS n, median(value) AS median, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95, avg(value) AS mean,
  stddev_samp(value) AS std, {m} FROM {src} GROUP BY {by}"""


def gate(src: str) -> str:
    return f"SELECT factor, skew, kurt, coalesce(abs(skew) > 2 OR kurt > 5, false) AS needed FROM (SELECT factor, median(skew) AS skew, median(kurt) AS kurt FROM ({moments(src)}) GROUP BY factor)"


def autoregression(lags: int, src: str) -> str:
    """(factor, asset, n, mean, p, phi, sigma2): the recursion over autocovariances, written out."""
    cols = ", ".join(f"lag(c, {k}) OVER ({A} ORDER BY date) AS c{k}" for k in range(1, lags + 1))
    sums = ", ".join(f"coalesce(sum(c * c{k}), 0.0) / count(c) AS g{k}" for k in range(1, lags + 1))
    x = f"SELECT factor, asset, count(c) AS n, first(m) AS mean, sum(c * c) / count(c) AS g0, {sums} FROM (SELECT *, {cols} FROM (SELECT *, avg(value) OVER ({A}) AS m, value - avg(value) OVER ({A}) AS c FROM {src})) GROUP BY factor, asset"
    x = f"SELECT *, g0 AS s0 FROM ({x})"
    for m in range(1, lags + 1):
        carried = " + ".join(["0.0", *(f"a{m - 1}_{j} * g{m - j}" for j in range(1, m))])
        x = f"SELECT *, CASE WHEN s{m - 1} > 0 THEN (g{m} - ({carried})) / s{m - 1} ELSE 0.0 END AS k{m} FROM ({x})"
        new = ", ".join([*(f"a{m - 1}_{j} - k{m} * a{m - 1}_{m - j} AS a{m}_{j}" for j in range(1, m)), f"k{m} AS a{m}_{m}", f"s{m - 1} * (1 - k{m} * k{m}) AS s{m}"])
        x = f"SELECT *, {new} FROM ({x})"
    score = [f"CASE WHEN s{p} > 0 THEN round(n * ln(s{p}) + {2.0 * p}, 6) END" for p in range(lags + 1)]
    best = f"least({', '.join(score)})"
    order = "CASE WHEN n >= {} AND g0 > 1e-12 THEN CASE {} END ELSE 0 END".format(lags + 2, " ".join(f"WHEN {s} = {best} THEN {p}" for p, s in enumerate(score)))
    x = f"SELECT *, {order} AS p FROM ({x})"
    phi = " ".join(f"WHEN {p} THEN [{', '.join(f'a{p}_{j}' for j in range(1, p + 1))}]" for p in range(1, lags + 1))
    sigma = " ".join(f"WHEN {p} THEN s{p}" for p in range(1, lags + 1))
    return f"SELECT factor, asset, n, mean, p, CASE p {phi} ELSE CAST([] AS DOUBLE[]) END AS phi, CASE p {sigma} ELSE g0 END AS sigma2 FROM ({x})"


def innovations(lags: int = 3) -> Step:
    def step(src: str) -> str:
        past = ", ".join(f"lag(value, {k}) OVER ({A} ORDER BY date) AS l{k}" for k in range(1, lags + 1))
        terms = " + ".join(f"CASE WHEN p >= {k} THEN phi[{k}] * (l{k} - mean) ELSE 0.0 END" for k in range(1, lags + 1))
        return f"""SELECT factor, date, asset, coalesce(value - ({terms}), value) AS value, industry, known, mcap
FROM (SELECT *, {past} FROM {src}) JOIN (SELECT factor, asset, mean, p, phi FROM ({autoregression(lags, src)})) USING (factor, asset)"""

    return step


STATIC = (median_fill, winsorize, industry, zscore)
MIXED = (median_fill, sigma_clip(), industry, zscore)
DYNAMIC = (median_fill, industry, innovations(), industry, zscore)


# -- fingerprints


def factors() -> str:
    parts = [
        chain(supplier_month(), median_fill).replace("round(value, 6) + 0.0 AS value", "value, industry, known, mcap"),
        chain(supplier_month("quantity", "avg(l_quantity)"), median_fill).replace("round(value, 6) + 0.0 AS value", "value, industry, known, mcap"),
        chain(
            supplier_month("revenue_12m", "sum(l_extendedprice * (1 - l_discount))"), median_fill,
            replace(f"avg(value) OVER ({A} ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"),
        ).replace("round(value, 6) + 0.0 AS value", "value, industry, known, mcap"),
    ]
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def persistence(src: str, least: int) -> str:
    return f"""SELECT factor, median(ar1) AS ar1_median, quantile_cont(ar1, 0.75) - quantile_cont(ar1, 0.25) AS ar1_iqr, median(vol) AS vol_cluster FROM (
  SELECT factor, asset, CASE WHEN k >= {least} AND v1 > 0 AND v2 > 0 THEN a END AS ar1, CASE WHEN k >= {least} AND w1 > 0 AND w2 > 0 THEN b END AS vol FROM (
    SELECT factor, asset, count(CASE WHEN value IS NOT NULL AND p IS NOT NULL THEN 1 END) AS k, corr(value, p) AS a, corr(sq, psq) AS b,
      regr_sxx(value, p) AS v1, regr_syy(value, p) AS v2, regr_sxx(sq, psq) AS w1, regr_syy(sq, psq) AS w2 FROM (
      SELECT *, lag(value) OVER ({A} ORDER BY date) AS p, lag(sq) OVER ({A} ORDER BY date) AS psq FROM (SELECT *, pow(value - avg(value) OVER ({A}), 2) AS sq FROM {src}))
    GROUP BY factor, asset)) GROUP BY factor"""


def prints(src: str, least: int = 24) -> str:
    ranks = f"""SELECT factor, avg(CASE WHEN x > 0 AND y > 0 THEN c END) AS rank_autocorr FROM (SELECT factor, date, corr(r, b) AS c, regr_sxx(r, b) AS x, regr_syy(r, b) AS y FROM (
  SELECT *, lag(r) OVER ({A} ORDER BY date) AS b FROM (SELECT factor, date, asset, CASE WHEN v IS NOT NULL THEN
    rank() OVER ({D}, v IS NOT NULL ORDER BY v) + (count(*) OVER ({D}, v IS NOT NULL, v) - 1) / 2.0 END AS r FROM (SELECT *, round(value, 9) AS v FROM {src}))) GROUP BY factor, date) GROUP BY factor"""
    cross = f"""SELECT factor, stddev_samp(skew) AS skewness_std, stddev_samp(kurt) AS kurtosis_std, avg(std) AS cs_dispersion, sum(n) / sum(every) AS coverage, avg(skew) AS s, avg(kurt) AS k FROM (
  SELECT *, (SELECT 1) AS one FROM ({moments(src, 'factor, date')})) JOIN (SELECT factor, date, count(*) AS every FROM {src} GROUP BY ALL) USING (factor, date) GROUP BY factor"""
    bins = ", ".join(f"count(CASE WHEN bin = {k} THEN 1 END) / count(*) AS p{k}" for k in range(10))
    lags = ", ".join(f"lag(p{k}) OVER (PARTITION BY factor ORDER BY date) AS q{k}" for k in range(10))
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * ln(2 * {a} / ({a} + {b})) ELSE 0.0 END"
    js = " + ".join(f"{part(f'p{k}', f'q{k}')} + {part(f'q{k}', f'p{k}')}" for k in range(10))
    cuts = ", ".join(f"{k / 10}" for k in range(1, 10))
    diverged = f"""SELECT factor, avg(({js}) / 2) AS js_divergence_mean FROM (SELECT *, {lags} FROM (SELECT factor, date, {bins} FROM (
  SELECT factor, date, len(list_filter(cuts, lambda c: round(c, 9) < v)) AS bin FROM (SELECT *, round(value, 9) AS v FROM {src} WHERE value IS NOT NULL)
  JOIN (SELECT factor, quantile_cont(round(value, 9), [{cuts}]) AS cuts FROM {src} GROUP BY factor) USING (factor)) GROUP BY factor, date)) WHERE q0 IS NOT NULL GROUP BY factor"""
    return f"""SELECT factor, ar1_median, ar1_iqr, rank_autocorr, CASE WHEN ar1_median > 0 AND ar1_median < 1 THEN -ln(2) / ln(ar1_median) ELSE 0.0 END AS half_life, vol_cluster, skewness_std, kurtosis_std,
  js_divergence_mean, 0.5 * ar1_median + 0.5 * rank_autocorr AS sd_score, least(1.0, 0.5 * abs(s) / 2.0 + 0.5 * greatest(k, 0.0) / 5.0) AS complexity_need,
  least(100.0, ar1_median * ar1_median / nullif(1 - ar1_median * ar1_median, 0.0)) AS snr_estimate, coverage, cs_dispersion
FROM ({persistence(src, least)}) LEFT JOIN ({ranks}) USING (factor) LEFT JOIN ({cross}) USING (factor) LEFT JOIN ({diverged}) USING (factor)"""


def typed(src: str) -> str:
    """Classes from fingerprints."""
    kind = "CASE WHEN ar1_median > 0.8 AND rank_autocorr > 0.7 THEN 'STATIC' WHEN ar1_median < 0.4 THEN 'DYNAMIC' ELSE 'MIXED' END"
    logs = {"DYNAMIC": (0.2, 0.1), "MIXED": (0.6, 0.15), "STATIC": (0.85, 0.1)}
    e = {t: f"-0.5 * pow((ar1_median - {m}) / {s}, 2) - ln({s})" for t, (m, s) in logs.items()}
    return f"""SELECT f.factor, primary_type, max(CASE WHEN t = primary_type THEN p END) AS primary_prob, arg_max(CASE WHEN t <> primary_type THEN t END, CASE WHEN t <> primary_type THEN p - o END) AS secondary_type,
  max(CASE WHEN t <> primary_type THEN p END) AS secondary_prob, max(p) - list_sort(list(p))[2] AS confidence, any_value(hard) AS is_hard FROM (
  SELECT factor, {kind} AS primary_type, coalesce(least(abs(ar1_median - 0.8), abs(ar1_median - 0.4)) > 0.1, false) AS hard FROM {src}) f JOIN (
  SELECT factor, t, o, round(exp(l - max(l) OVER w) / sum(exp(l - m)) OVER w, 9) AS p FROM (SELECT *, max(l) OVER (PARTITION BY factor) AS m FROM (
    {' UNION ALL '.join(f"SELECT factor, '{t}' AS t, {k}e-12 AS o, {x} AS l FROM {src}" for k, (t, x) in enumerate(e.items()))})) WINDOW w AS (PARTITION BY factor)) p ON p.factor = f.factor
GROUP BY f.factor, primary_type"""


def yearly(src: str) -> str:
    return f"SELECT * REPLACE (factor || '@' || year(date) AS factor) FROM {src}"


def rounded(columns: str, doubles: str, src: str) -> str:
    return f"SELECT {columns}{', ' if columns and doubles else ''}{', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in doubles.split())} FROM {src}"


FACTORS = "x AS MATERIALIZED ({})"
ALL_PRINTS = "ar1_median ar1_iqr rank_autocorr half_life vol_cluster skewness_std kurtosis_std js_divergence_mean sd_score complexity_need snr_estimate coverage cs_dispersion"


#: Queries whose rows are no cells of a panel.
WITHOUT_DATE = set(
    "null_profile missing_kind asset_moments transform_need_gate ar_order_select decouple_summary step_report step_bottlenecks fingerprints classes semantic_fusion "
    "fingerprint_history latest_fingerprint stability_score type_migrations transition_weights".split()
)


def oracle_sql() -> dict[str, str]:
    two = f"SELECT * FROM ({supplier_month()}) UNION ALL SELECT * FROM ({USER_DAY})"
    x = FACTORS.format(factors())
    history = f"h AS (SELECT split_part(p.factor, '@', 1) AS factor, make_date(CAST(split_part(p.factor, '@', 2) AS INT), 12, 31) AS as_of, primary_type, confidence, ar1_median, rank_autocorr FROM yp p JOIN yt t ON t.factor = p.factor)"
    yearly_parts = f"{x}, y AS ({yearly('x')}), yp AS ({prints('y', 6)}), yt AS ({typed('yp')}), {history}"
    per_factor = f"{x}, p AS ({prints('x')}), t AS ({typed('p')})"
    out = {
        "panel_dense": f"SELECT factor, date, asset, round(value, 6) + 0.0 AS value, industry, known FROM ({supplier_month()})",
        "null_profile": f"""SELECT factor, count(DISTINCT date) AS n_dates, count(DISTINCT asset) AS n_assets, count(*) AS n_cells, count(CASE WHEN value IS NULL THEN 1 END) AS n_missing,
  round(count(CASE WHEN value IS NULL THEN 1 END) / count(*), 6) + 0.0 AS missing_rate FROM ({two}) GROUP BY factor""",
        "missing_kind": f"""SELECT factor, round(avg(gap), 6) + 0.0 AS missing_rate, round(coalesce(abs(corr(gap, mean)), 0.0), 6) + 0.0 AS level_link,
  CASE WHEN max(gap) = 0 THEN 'none' WHEN coalesce(abs(corr(gap, mean)), 0.0) > 0.3 THEN 'level_related' ELSE 'random' END AS kind
FROM (SELECT factor, asset, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS gap, avg(value) AS mean FROM ({two}) GROUP BY ALL) GROUP BY factor""",
        "asset_moments": f"WITH s AS ({supplier_month()}) " + rounded("factor, asset, n", "median q05 q95 mean std skew kurt", f"({moments('s')})"),
        "pivot_wide": f"""WITH s AS ({supplier_month()}), e AS (SELECT min(asset) AS a, max(asset) AS z FROM s)
SELECT factor, date, count(DISTINCT asset) AS n_assets, count(value) AS n_present, round(min(value), 6) + 0.0 AS lowest, round(max(value), 6) + 0.0 AS highest,
  round(max(CASE WHEN asset = a THEN value END), 6) + 0.0 AS first_asset, round(max(CASE WHEN asset = z THEN value END), 6) + 0.0 AS last_asset FROM s, e GROUP BY factor, date""",
        "unpivot_long": f"SELECT factor, date, asset, round(value, 6) + 0.0 AS value FROM ({supplier_month()})",
        "impute_median": chain(USER_DAY, median_fill),
        "impute_mean": chain(USER_DAY, mean_fill),
        "impute_constant": chain(USER_DAY, zero_fill),
        "impute_cross_section_mean": chain(USER_DAY, date_fill),
        "impute_ffill": chain(USER_DAY, ffill),
        "impute_hierarchical": chain(USER_DAY, hierarchical),
        "impute_most_frequent": chain(supplier_month(), replace("floor(value * 100 + 0.001) / 100"), most_frequent),
        "impute_fitted": chain(supplier_month(), fitted_medians),
        "winsorize_5_95": chain(supplier_month(), winsorize),
        "outlier_mad": chain(USER_DAY, mad(A, 2.0, MAD_CLIP)),
        "outlier_adaptive": chain(USER_DAY, mad(A, 2.0, f"CASE WHEN mad > 0 THEN {MAD_CLIP} ELSE {clip(f'med - 2 * stddev_samp(value) OVER ({A})', f'med + 2 * stddev_samp(value) OVER ({A})')} END")),
        "outlier_sigmoid": chain(USER_DAY, mad(A, 2.0, SIGMOID)),
        "outlier_iqr": chain(USER_DAY, replace(clip("q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"), q1=f"quantile_cont(value, 0.25) OVER ({A})", q3=f"quantile_cont(value, 0.75) OVER ({A})")),
        "outlier_z_score": chain(USER_DAY, replace(clip("m - 2 * sd", "m + 2 * sd"), m=f"avg(value) OVER ({A})", sd=f"stddev_samp(value) OVER ({A})")),
        "outlier_percentile": chain(USER_DAY, replace(clip(f"quantile_cont(value, 0.01) OVER ({A})", f"quantile_cont(value, 0.99) OVER ({A})"))),
        "outlier_percentile_panel": chain(USER_DAY, replace(clip("quantile_cont(value, 0.01) OVER (PARTITION BY factor)", "quantile_cont(value, 0.99) OVER (PARTITION BY factor)"))),
        "outlier_mad_panel": chain(USER_DAY, mad("PARTITION BY factor", 3.0, MAD_CLIP)),
        "mixed_clip_3sigma": chain(supplier_month(), sigma_clip("date < DATE '1996-01-01'")),
        "zscore": chain(supplier_month(), zscore),
        "std_rank": chain(supplier_month(), percent_rank("factor, date")),
        "std_minmax": chain(supplier_month(), replace("CASE WHEN value IS NOT NULL THEN CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0 END END", lo=f"min(value) OVER ({A})", hi=f"max(value) OVER ({A})")),
        "std_robust": chain(supplier_month(), replace("(value - med) / CASE WHEN q = 0 THEN 1 ELSE q END", med=f"median(value) OVER ({A})", q=f"quantile_cont(value, 0.75) OVER ({A}) - quantile_cont(value, 0.25) OVER ({A})")),
        "transform_log": chain(USER_DAY, replace("sign(value) * ln(1 + abs(value))")),
        "transform_quantile": chain(USER_DAY, percent_rank("factor, asset")),
        "box_cox": chain(USER_DAY, power("box_cox")),
        "yeo_johnson": chain(USER_DAY, replace("value - 40"), power("yeo_johnson")),
        "neutralize_industry": chain(USER_DAY, industry),
        "neutralize_filtered": chain(USER_DAY, filtered),
        "neutralize_ridge": chain(USER_DAY, ridge),
        "neutralize_index": chain(supplier_month(), index),
        "neutralize_mcap": chain(supplier_month(), sized(f"{D}, use")),
        "neutralize_industry_mcap": chain(supplier_month(), sized(f"{D}, g, use")),
        "neutralize_wls": chain(supplier_month(), wls),
        "rolling_whiten": chain(supplier_month(), rolling),
        "ar_residual": chain(supplier_month(), median_fill, innovations()),
        "v1_five_step": chain(supplier_month(), median_fill, winsorize, zscore, industry),
        "v1_four_step": chain(USER_DAY, median_fill, winsorize, zscore, filtered),
        "static_pipeline": chain(supplier_month(), *STATIC),
        "dynamic_pipeline": chain(supplier_month(), *DYNAMIC),
    }
    parts, last = ctes(two)
    out["transform_need_gate"] = f"WITH {parts} " + rounded("factor, needed", "skew kurt", f"({gate(last)})")
    parts, last = ctes(supplier_month(), median_fill, industry)
    out["residual_group_means"] = f"WITH {parts} SELECT factor, date, industry, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_residual FROM {last} GROUP BY ALL"
    parts, last = ctes(supplier_month(), median_fill)
    out["ar_order_select"] = f"WITH {parts} SELECT factor, asset, n, CAST(p AS INT) AS p, round(coalesce(phi[1], 0.0), 6) + 0.0 AS phi1, round(sigma2, 6) + 0.0 AS sigma2 FROM ({autoregression(3, last)})"
    parts, last = ctes(supplier_month(), median_fill, industry)
    out["decouple_summary"] = f"""WITH {parts}, f AS (SELECT factor, avg(p) AS mean_order, CAST(max(p) AS INT) AS max_order, avg(sqrt(sigma2)) AS residual_std FROM ({autoregression(3, last)}) GROUP BY factor),
b AS (SELECT factor, stddev_samp(value) AS std_before, count(DISTINCT industry) AS industry_count, count(DISTINCT asset) AS stock_count FROM s1 GROUP BY factor), a AS (SELECT factor, stddev_samp(value) AS std_after FROM {last} GROUP BY factor)
""" + rounded("factor, industry_count, stock_count, max_order", "std_before std_after mean_order residual_std", "b JOIN a USING (factor) JOIN f USING (factor)")
    # the gate of the mixed pipeline is taken on the imputed panel, before it is clipped
    parts, last = ctes(USER_DAY, median_fill, sigma_clip(), power("yeo_johnson"))
    gated = f"{parts}, g AS ({gate('s1')}), s4 AS (SELECT * FROM s3 WHERE factor IN (SELECT factor FROM g WHERE needed) UNION ALL SELECT factor, date, asset, value, industry, known, mcap FROM s2 WHERE factor NOT IN (SELECT factor FROM g WHERE needed)), s5 AS ({industry('s4')}), s6 AS ({zscore('s5')})"
    out["mixed_pipeline"] = f"WITH {gated} SELECT factor, date, asset, round(value, 6) + 0.0 AS value FROM s6"
    records = "SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS seq, o_orderpriority AS step, CAST(count(*) AS DOUBLE) AS ms FROM orders GROUP BY ALL"
    out["step_report"] = f"""SELECT count(*) AS n_steps, sum(ms) AS total_ms, round(avg(ms), 6) + 0.0 AS avg_ms, max(ms) AS max_ms, min(ms) AS min_ms, arg_max(step, ms * 100 - seq) AS slowest,
  arg_min(step, ms * 100 + seq) AS fastest, true AS success, count(*) AS n_ok FROM ({records})"""
    out["step_bottlenecks"] = f"SELECT seq, step, ms, round(share_pct, 6) + 0.0 AS share_pct FROM (SELECT *, 100 * ms / sum(ms) OVER () AS share_pct FROM ({records})) WHERE share_pct >= 20"
    out["fingerprints"] = f"WITH {x} " + rounded("factor", ALL_PRINTS, f"({prints('x')})")
    out["classes"] = f"WITH {per_factor} " + rounded("factor, primary_type, secondary_type, is_hard", "primary_prob secondary_prob confidence", "t")
    told = "(VALUES ('discount', 'DYNAMIC', 0.5, 48), ('quantity', 'MIXED', 1.0, 2), ('revenue_12m', 'DYNAMIC', 1.0, 12)) d(factor, sem, strength, months)"
    fused = "CASE WHEN sem = primary_type THEN {} WHEN enough < 0.3 THEN {} WHEN enough < 0.7 THEN {} ELSE {} END"
    out["semantic_fusion"] = f"""WITH {per_factor}, j AS (SELECT t.*, p.ar1_median, d.sem, d.strength, 0.6 * least(d.months / 24.0, 1.0) + 0.4 * coalesce(p.coverage, 0.0) AS enough
  FROM t JOIN p ON p.factor = t.factor JOIN {told.replace("('discount', 'DYNAMIC', 0.5", "('discount', 'DYNAMIC', 2.0 / 2")} ON d.factor = t.factor)
SELECT factor, {fused.format('primary_type', 'sem', "'MIXED'", 'primary_type')} AS primary_type,
  round({fused.format('least(confidence * (1 + 0.3 * strength), 1.0)', '0.7 * strength', '0.5', '0.6 * confidence')}, 6) + 0.0 AS confidence,
  round(least(5 * least(abs(ar1_median - 0.8), abs(ar1_median - 0.4)), 1.0), 6) + 0.0 AS data_weight, round(enough, 6) + 0.0 AS data_sufficiency,
  {fused.format('NULL', "'SEMANTIC_OVERRIDE'", "'DOWNGRADED_TO_MIXED'", "'HUMAN_REVIEW'")} AS conflict_reason FROM j"""
    out["fingerprint_history"] = f"WITH {yearly_parts} " + rounded("factor, as_of, primary_type", "confidence ar1_median rank_autocorr", "h")
    out["latest_fingerprint"] = f"WITH {yearly_parts} " + rounded("factor, as_of, primary_type", "ar1_median", "(SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY factor ORDER BY as_of DESC) = 1)")
    out["stability_score"] = f"WITH {yearly_parts} SELECT factor, CAST(sum(k) AS BIGINT) AS n, round(max(k) / sum(k), 6) + 0.0 AS stability FROM (SELECT factor, primary_type, count(*) AS k FROM h GROUP BY ALL) GROUP BY factor"
    out["type_migrations"] = f"""WITH {yearly_parts}, p AS ({prints('x')}), t AS ({typed('p')}), old AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY factor ORDER BY as_of DESC) = 1)
SELECT factor, CASE WHEN 'STATIC' IN (from_type, to_type) AND 'DYNAMIC' IN (from_type, to_type) THEN 'CRITICAL' ELSE 'WARNING' END AS level, from_type, to_type, round(d, 6) + 0.0 AS ar1_change, 12 AS "window"
FROM (SELECT old.factor, old.primary_type AS from_type, t.primary_type AS to_type, abs(p.ar1_median - old.ar1_median) AS d FROM old JOIN t ON t.factor = old.factor JOIN p ON p.factor = old.factor)
WHERE from_type <> to_type AND d > 0.01"""
    w = {"static": "exp(-abs(ar1_median - 0.85))", "mixed": "exp(-abs(ar1_median - 0.6))", "dynamic": "exp(-abs(ar1_median - 0.2))"}
    total = " + ".join(w.values())
    out["transition_weights"] = f"WITH {x} SELECT factor, " + ", ".join(f"round({e} / ({total}), 6) + 0.0 AS \"{n}\"" for n, e in w.items()) + f" FROM ({persistence('x', 24)})"
    routes = []
    for kind, steps in (("STATIC", STATIC), ("DYNAMIC", DYNAMIC), ("MIXED", MIXED)):
        names = [f"SELECT * FROM x WHERE factor IN (SELECT factor FROM t WHERE primary_type = '{kind}')"]
        cte = f"{kind}0 AS ({names[0]})"
        for k, s in enumerate(steps):
            cte += f", {kind}{k + 1} AS ({s(f'{kind}{k}')})"
        routes.append((cte, f"SELECT factor, date, asset, value FROM {kind}{len(steps)}"))
    out["v2_router"] = f"WITH {per_factor}, {', '.join(c for c, _ in routes)} SELECT factor, date, asset, round(value, 6) + 0.0 AS value FROM ({' UNION ALL '.join(q for _, q in routes)})"
    out = {k: v.replace(", 6) + 0.0", " + 1e-9, 6) + 0.0") for k, v in out.items()}  # exact ties go one way
    dates = dict.fromkeys(set(out) - WITHOUT_DATE, "date") | dict.fromkeys(("fingerprint_history", "latest_fingerprint"), "as_of")
    return {k: f"SELECT * REPLACE (CAST({dates[k]} AS VARCHAR) AS {dates[k]}) FROM ({v})" if k in dates else v for k, v in out.items()}
