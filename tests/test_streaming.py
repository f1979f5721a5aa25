"""The monitor over a stream of files."""

from pyspark.sql import functions as F

from panelwright.sources import synthetic
from panelwright.streaming import monitor


def test_monitor_stream(spark, tmp_path):
    cells, history, alerts = tmp_path / "cells", str(tmp_path / "history"), []
    for k, kind in enumerate(("static", "dynamic")):
        synthetic.autoregressive(spark, kind, 40, 12).withColumn("factor", F.lit("f")).coalesce(1).write.mode("append").parquet(str(cells))
        q = monitor.watch(monitor.read_cells(spark, str(cells)), history, str(tmp_path / "checkpoint"), lambda a, b: alerts.extend(a.collect()))
        q.awaitTermination()
        assert spark.read.parquet(history).select("batch").distinct().count() == k + 1
    assert [(a.factor, a.from_type, a.to_type) for a in alerts] == [("f", "STATIC", "DYNAMIC")]
    again = monitor.record(spark.read.parquet(str(cells)).limit(0), 1, history)  # a replayed batch replaces its own rows
    assert again.isEmpty() and spark.read.parquet(f"{history}/batch=0").count() == 1
