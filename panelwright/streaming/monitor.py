"""A stream of panel cells that keeps a fingerprint history.

Each micro-batch is a set of new cells (whole periods, as a loader delivers
them).  It is fingerprinted, compared with the history's last rows, and
appended.  A batch's rows carry its number, and a batch that is replayed after a
failure replaces its own folder, so history holds each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import classify
from ..operators.fingerprint import fingerprint
from ..operators.monitor import migrations
from ..sources.panels import PANEL


def read_cells(spark, path: str) -> DataFrame:
    """New panel files in a folder, as a stream."""
    return spark.readStream.schema(PANEL).parquet(path)


def record(batch: DataFrame, batch_id: int, history_path: str, min_window: int = 6) -> DataFrame:
    """Append a batch's fingerprints; the rows written."""
    batch = batch.persist()
    prints = fingerprint(batch, min_window)
    rows = prints.join(classify(prints), "factor").join(batch.groupBy("factor").agg(F.max("date").alias("as_of")), "factor")
    out = f"{history_path}/batch={batch_id}"
    rows.select("factor", "as_of", "primary_type", "confidence", "ar1_median", "rank_autocorr").write.mode("overwrite").parquet(out)
    batch.unpersist()
    return batch.sparkSession.read.parquet(out)


def watch(cells: DataFrame, history_path: str, checkpoint: str, on_alerts=None, min_window: int = 6, threshold: float = 0.10):
    """Start the stream; ``on_alerts(alerts, batch_id)`` gets each batch's migrations. Returns the query."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows = record(batch, batch_id, history_path, min_window)
        if on_alerts and batch_id:
            known = batch.sparkSession.read.parquet(history_path).where(F.col("batch") < batch_id)
            on_alerts(migrations(known, rows, threshold), batch_id)

    return cells.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
