"""Mixing sources to target weights, natively.

Every document gets a random key from a hash of its id.  Keys are uniform, so
equal key ranges are a range partition that needs no sampling and is the same
on every run; a source of any size spreads over all of them.  Sums of the
(source, range) cells give offsets, a window inside each cell gives the rest,
and together they are the prefix sums of each source in key order.  A source's
budget is cut exactly: whole epochs first, then documents until it is spent,
the last of them in part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, words

WEIGHTS = (5, 2, 1)


def budgets(sources: DataFrame, weights=WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target) for a table (source, source_size) with a row per source.

    Weights repeat over sources in code-point order, null last.  Each source
    gets ``level * weight``, at most ``most`` times its size, with the one level at
    which targets add up to ``percent`` of all sizes: sources are sorted by the
    level at which they fill, and running sums find it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    x = sources.select("source", "source_size", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    x = x.withColumn("full_at", F.col("cap") / F.col("w"))
    below = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x = x.select(
        "*",
        (F.lit(percent / 100) * F.sum("source_size").over(every)).alias("total"),
        F.coalesce(F.sum("cap").over(below), F.lit(0.0)).alias("filled"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0))).alias("open_w"),
    )
    # the first source, in this order, that would not be full at the level its rest allows
    x = x.withColumn("level", (F.col("total") - F.col("filled")) / F.col("open_w"))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"]
    return x.select("source", "source_size", F.coalesce(F.least(F.col("w") * level, F.col("cap")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, percent: int = 150, most: int = 2, salt: str = "mix", cell_rows: int = 50_000, min_cells: int = 64,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All input columns, plus size, source_size, target, taken.

    size counts the words of a text (null: 0); taken is how many of them the
    mix uses, repeats counted, at most ``most`` times size.  A null source is a
    source of its own; ties of the hash are broken by id, then size; equal rows
    may swap, which changes no result; input columns with these names are
    replaced; an empty table gives no rows.
    """
    out = ("size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c not in out]
    size: Column = F.size(words(F.col(text_col))).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{salt}")))
    # 24 leading bits of the key choose the range; its count follows the table's
    n = docs.count()
    cells = max(min_cells, 1 << math.ceil(math.log2(max(1, n / cell_rows))))
    cell = F.floor(F.conv(F.substring(key, 1, 6), 16, 10).cast("long") * cells / F.lit(1 << 24)).cast("int")
    keyed = docs.select(*keep, size.alias("size"), key.alias("__key"), F.col(source_col).alias("__source"), cell.alias("__cell"))
    sums = keyed.groupBy("__source", "__cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__source", "__cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("offset"))
    plan = budgets(sums.groupBy(F.col("__source").alias("source")).agg(F.sum("cell_size").alias("source_size")), weights, percent, most)
    offsets = (
        offsets.join(plan, F.col("__source").eqNullSafe(F.col("source")))
        .select(F.col("__source").alias("s"), F.col("__cell").alias("c"), "offset", "source_size", "target")
    )
    inside = Window.partitionBy("__source", "__cell").orderBy("__key", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(offsets, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__cell") == F.col("c")), "left")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("__inside")))
    return joined.select(*keep, "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def apply_mix(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that a mix uses: one for each time a document is taken, the last cut to the words taken.

    Documents without words are kept once: they cost no budget.
    """
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    left = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    copies = mixed.select("*", F.explode(F.concat(F.array_repeat(F.lit(0), full), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<int>")))).alias("__left"))
    first_words = F.array_join(F.slice(F.array_remove(F.split(F.col(text_col), SPACE), ""), F.lit(1), F.col("__left")), " ")
    return copies.withColumn(text_col, F.when(F.col("__left") > 0, first_words).otherwise(F.col(text_col))).drop("__left")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0::DOUBLE, 2.0, 1.0], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS w, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (
  SELECT *, cap / w AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS open_w
  FROM w),
l AS (SELECT arg_min((total - filled) / open_w, full_at) AS level FROM f WHERE (total - filled) / open_w <= full_at),
t AS (SELECT source, source_size, coalesce(least(w * level, cap), cap) AS target FROM f LEFT JOIN l ON true),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
j AS (
  SELECT doc_id, size, source_size, target, before, CAST(round(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM j"""
