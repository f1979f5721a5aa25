"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents shrink to one number each, lengths to one row each, and everything
else is answered from the histogram.  Suffix sums run in two levels (sums of
length ranges, then inside a range), so no task sees the whole histogram.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, raw
from .tokens import load, vocabulary


def _lengths(batches, path: str):
    tokenizer = load(path)
    for b in batches:
        for at in range(0, b.num_rows, 512):
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 2 for x in tokenizer.ids(raw(b.slice(at, 512), "text"))], pa.int64())], ["tokens"])


def length_histogram(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """(tokens, n_docs): every encoded length that occurs. Null texts encode to no token; repeated rows count."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_lengths, path=tokenizer or vocabulary()), "tokens long")
    return found.groupBy("tokens").agg(F.count("*").alias("n_docs"))


def length_answers(histogram: DataFrame, span: int = 4096) -> DataFrame:
    """For a context limit at each length that occurs: how documents and tokens fall.

    limit_tokens, n_docs (of that length), docs_within, docs_beyond (longer),
    tokens_within (of documents within), total_docs, total_tokens,
    truncated_tokens (if every document is cut at the limit), quantile (share
    of documents within).  An empty histogram gives no rows.  Any other
    limit c lies between two rows: its truncated total is the lower row's
    tokens_within + c * docs_beyond; ``truncated_total`` computes it.
    """
    # read twice below: written, so that texts are encoded once
    h = checkpointed(histogram).select("tokens", "n_docs", (F.col("tokens") * F.col("n_docs")).alias("sum"), F.floor(F.col("tokens") / span).alias("range"))
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("rd"), F.sum("sum").alias("rt"))
    above = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("rd").over(above), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("rt").over(above), F.lit(0)).alias("t0"),
        F.sum("rd").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total_docs"),
        F.sum("rt").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total_tokens"),
    )
    inside = Window.partitionBy("range").orderBy(F.col("tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = h.join(ranges, "range").select(
        "tokens", "n_docs", "total_docs", "total_tokens",
        (F.col("d0") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_beyond"),
        (F.col("t0") + F.coalesce(F.sum("sum").over(inside), F.lit(0))).alias("beyond"),
    )
    within: Column = F.col("total_tokens") - F.col("beyond")
    return x.select(
        F.col("tokens").alias("limit_tokens"),
        "n_docs",
        (F.col("total_docs") - F.col("docs_beyond")).alias("docs_within"),
        "docs_beyond",
        within.alias("tokens_within"),
        "total_docs",
        "total_tokens",
        (within + F.col("tokens") * F.col("docs_beyond")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_beyond")) / F.col("total_docs")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """The tokens left when every document is cut at any limit."""
    return histogram.agg(F.coalesce(F.sum(F.least("tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"))


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """The smallest length within which a share q of the documents lies."""
    return answers.where(F.col("docs_within") >= F.ceil(F.lit(q) * F.col("total_docs"))).agg(F.min("limit_tokens").alias("tokens"))
