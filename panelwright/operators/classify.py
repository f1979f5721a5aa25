"""Types of factors from fingerprints, from descriptions, and from both."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the types and the normal priors of first-order correlation by type.
STATIC_AR1, STATIC_RANK, DYNAMIC_AR1 = 0.80, 0.70, 0.40
PRIORS = {"STATIC": (0.85, 0.10), "MIXED": (0.60, 0.15), "DYNAMIC": (0.20, 0.10)}

#: Words that speak for a type in a description.
LEXICON = {
    "STATIC": ("value", "book", "earnings", "quality", "size", "profit", "balance", "fundamental", "price level", "估值", "盈利", "质量", "市值", "财务"),
    "DYNAMIC": ("momentum", "reversal", "turnover", "volatility", "flow", "intraday", "short-term", "动量", "反转", "换手", "波动", "资金流"),
    "MIXED": ("growth", "sentiment", "revision", "analyst", "volume", "成长", "情绪", "预期", "分析师"),
}


def _ordered(scores: dict[str, Column]) -> Column:
    """Types as structs, best first; a tie goes to the name that sorts first."""
    return F.array_sort(F.array(*[F.struct((-s).alias("o"), F.lit(t).alias("type"), s.alias("p")) for t, s in sorted(scores.items())]))


def classify(prints: DataFrame) -> DataFrame:
    """(factor, primary_type, primary_prob, secondary_type, secondary_prob, confidence, is_hard).

    The limits decide the type; probabilities are the normalised prior densities
    of ar1; confidence is the distance of the two largest; a factor well inside its
    type's limits is hard.  Without ar1 the type is MIXED.
    """
    a = F.col("ar1_median")
    kind = (
        F.when((a > STATIC_AR1) & (F.col("rank_autocorr") > STATIC_RANK), "STATIC").when(a < DYNAMIC_AR1, "DYNAMIC").otherwise("MIXED")
    )
    logs = {t: -0.5 * F.pow((a - m) / s, 2) - math.log(s) for t, (m, s) in PRIORS.items()}
    top = F.greatest(*logs.values())
    total = sum((F.exp(x - top) for x in logs.values()), F.lit(0.0))
    x = prints.select("factor", a, kind.alias("primary_type"), _ordered({t: F.round(F.exp(v - top) / total, 9) for t, v in logs.items()}).alias("s"))
    own = F.filter("s", lambda t: t["type"] == F.col("primary_type"))[0]
    other = F.filter("s", lambda t: t["type"] != F.col("primary_type"))[0]
    far = F.least(F.abs(F.col("ar1_median") - STATIC_AR1), F.abs(F.col("ar1_median") - DYNAMIC_AR1))
    return x.select(
        "factor", "primary_type", own["p"].alias("primary_prob"), other["type"].alias("secondary_type"), other["p"].alias("secondary_prob"),
        (F.col("s")[0]["p"] - F.col("s")[1]["p"]).alias("confidence"), F.coalesce(far > 0.1, F.lit(False)).alias("is_hard"),
    )


def semantic(descriptions: DataFrame, lexicon: dict[str, tuple[str, ...]] = LEXICON) -> DataFrame:
    """(factor, semantic_type, strength): the type with most words in a description, and its share of all words found."""
    text = F.lower("description")
    hits = {t: sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0)) for t, words in lexicon.items()}
    total = sum(hits.values(), F.lit(0))
    best = _ordered(hits)[0]
    return descriptions.select("factor", F.when(total > 0, best["type"]).alias("semantic_type"), F.when(total > 0, best["p"] / total).alias("strength"))


def fuse(classes: DataFrame, prints: DataFrame, descriptions: DataFrame, months: DataFrame | None = None, lexicon: dict[str, tuple[str, ...]] = LEXICON) -> DataFrame:
    """Classes revised by descriptions.

    Agreement raises confidence by 30 % of the description's strength.  On conflict
    the sufficiency of data decides (0.6 months/24 + 0.4 coverage): below 0.3 the
    description wins at 0.7 of its strength; up to 0.7 the factor is MIXED; from
    there statistics win at 0.6 of their confidence, for review.
    """
    x = classes.join(prints.select("factor", "ar1_median", "coverage"), "factor").join(semantic(descriptions, lexicon), "factor", "left")
    x = x.join(months.select("factor", "data_months"), "factor", "left") if months is not None else x.withColumn("data_months", F.lit(0))
    enough = 0.6 * F.least(F.coalesce("data_months", F.lit(0)) / 24.0, F.lit(1.0)) + 0.4 * F.coalesce("coverage", F.lit(0.0))
    near = F.least(F.abs(F.col("ar1_median") - STATIC_AR1), F.abs(F.col("ar1_median") - DYNAMIC_AR1))
    silent, agree = F.col("semantic_type").isNull(), F.col("semantic_type") == F.col("primary_type")
    few, some = enough < 0.3, enough < 0.7

    def by(quiet, same, low, middle, high):
        return F.when(silent, quiet).when(agree, same).when(few, low).when(some, middle).otherwise(high)

    return x.select(
        "factor",
        by(F.col("primary_type"), F.col("primary_type"), F.col("semantic_type"), F.lit("MIXED"), F.col("primary_type")).alias("primary_type"),
        by(F.col("confidence"), F.least(F.col("confidence") * (1 + 0.3 * F.col("strength")), F.lit(1.0)), 0.7 * F.col("strength"), F.lit(0.5), 0.6 * F.col("confidence")).alias("confidence"),
        F.least(5 * near, F.lit(1.0)).alias("data_weight"),
        enough.alias("data_sufficiency"),
        by(F.lit(None), F.lit(None), F.lit("SEMANTIC_OVERRIDE"), F.lit("DOWNGRADED_TO_MIXED"), F.lit("HUMAN_REVIEW")).cast("string").alias("conflict_reason"),
    )
