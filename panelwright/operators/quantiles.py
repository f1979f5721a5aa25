"""Exact quantiles of all cells of a factor, without a factor's values in one task.

Cells are counted by value, which is the only reading of the panel; the rest reads
that exchange.  A sample of values by hash cuts a factor into stretches.  Counting
them tells where each rank lies, and only stretches that hold a wanted rank are
sorted.  Ranks come from counts, so the result is exact whatever the sample is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: One distinct value in so many is sampled, and the sample is cut into so many stretches.
RATE, STRETCHES = 1024, 64


def _cuts(values: DataFrame, rate: int) -> DataFrame:
    """(factor, cuts): ends of stretches with about as many distinct values each."""
    some = values.where(F.pmod(F.xxhash64("factor", "v"), F.lit(rate)) == 0)
    return some.groupBy("factor").agg(F.percentile("v", F.array(*[F.lit(k / STRETCHES) for k in range(1, STRETCHES)])).alias("cuts"))


def panel_quantiles(panel: DataFrame, qs: Sequence[float], value: str = "value", rate: int = RATE) -> DataFrame:
    """(factor, q0, q1, ...): linearly interpolated quantiles of a factor's non-null values; a factor without any has no row.

    Ties and repeated rows count as often as they occur.
    """
    counted = panel.where(F.col(value).isNotNull()).groupBy("factor", F.col(value).alias("v")).agg(F.count("*").alias("n"))
    place = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < F.col("v")))
    binned = counted.join(_cuts(counted, rate), "factor", "left").select("factor", "v", "n", place.alias("bin"))

    every = Window.partitionBy("factor")
    counts = binned.groupBy("factor", "bin").agg(F.sum("n").alias("n"))  # at most STRETCHES rows a factor
    counts = counts.select("*", (F.sum("n").over(every.orderBy("bin")) - F.col("n")).alias("below"), F.sum("n").over(every).alias("total"))
    ranks = []
    for k, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("total") - 1)
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            ranks.append(F.struct(F.lit(k).alias("k"), F.lit(end).alias("end"), rank.alias("rank"), (at - F.floor(at)).alias("part")))
    wanted = counts.select("*", F.explode(F.array(*ranks)).alias("r")).where("r.rank >= below AND r.rank < below + n")
    wanted = wanted.groupBy("factor", "bin").agg(F.collect_list(F.struct("r.k", "r.end", "r.part", (F.col("r.rank") - F.col("below")).alias("offset"))).alias("w"))

    values = binned.join(wanted.select("factor", "bin"), ["factor", "bin"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("factor", "bin").orderBy("v"))
    met = values.withColumn("upto", upto).join(wanted, ["factor", "bin"]).select("factor", "v", "upto", F.inline("w"))
    found = met.groupBy("factor", "k", "end", "part").agg(F.min(F.when(F.col("upto") > F.col("offset"), F.col("v"))).alias("v"))

    def pick(k: int, end: str):
        return F.max(F.when((F.col("k") == k) & (F.col("end") == end), F.col("v")))

    def between(k: int):
        low, high, part = pick(k, "low"), pick(k, "high"), F.max(F.when(F.col("k") == k, F.col("part")))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return found.groupBy("factor").agg(*[between(k).alias(f"q{k}") for k in range(len(qs))])
