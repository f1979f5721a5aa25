"""From raw documents to packed training sequences, in five stages.

Each stage is one operator of ``panelwright.llm``.  ``run`` writes a stage's rows
as Parquet and reads them back for the next one; a stage whose function is
called by itself sees any table with the columns of ``documents``, and more.

In every stage a null text counts as an empty one, an empty table gives no rows,
texts of any length are read whole, columns beside id, text and source pass
through, and null ids and sources are values like any other.  What each stage
does with ties and repeated rows is said in its operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import classifier, mixing, nearcopies, packing, substring
from panelwright.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more); repeated rows share a score."""
    return classifier.score(docs, table(spark, sf_dir, "labels"), docs.columns).where("__score >= 0.3").drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Near duplicates have SimHash fingerprints within four bits, as in ``op8``, found
    through its vantage-point tree; or they share four fifths of their five-word
    shingles (Jaccard similarity of 0.8 or more), which fingerprints mostly miss, see
    the README: their candidates come from min-hash bands and are compared exactly.
    Rows that share an id but not a text are documents of their own.
    """
    return nearcopies.keep_one(docs, radius=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one holds; n_chars follows the text."""
    out = substring.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a source's last one may be cut."""
    out = mixing.apply_mix(mixing.mix(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
