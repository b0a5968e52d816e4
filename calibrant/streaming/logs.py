"""Incremental forms of two table operators: the decision log and the quarantine split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calibrant.operators.evidence import latest_wins, route_quarantine
from calibrant.sources.tables import drop_path


def stream_latest(log: DataFrame, path: str, checkpoint: str, key: list[str], *newest: str) -> StreamingQuery:
    """E7 over a stream: after each batch a new version of the current decisions is written under ``path`` as
    ``v=<batch>``; :func:`current` reads the last one. A batch that is repeated after a failure writes the same version
    again, from the one before, so that two versions are kept. A batch costs one rewrite of the current decisions (a row
    per key): large batches are cheaper than many small ones."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id:
            rows = batch.sparkSession.read.parquet(f"{path}/v={batch_id - 1}").unionByName(batch)
        latest_wins(rows, key, *newest).where("is_current").drop("is_current").write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        if batch_id > 1:
            drop_path(batch.sparkSession, f"{path}/v={batch_id - 2}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={batch_id}")


def stream_quarantine(rows: DataFrame, path: str, checkpoint: str, *rules: tuple[Column, str, Column | str]) -> StreamingQuery:
    """B8 over a stream: accepted and quarantined rows below ``path``, partitioned by fate; no state is kept."""
    routed = route_quarantine(rows, *rules).withColumn("fate", F.when(F.col("reason").isNull(), "accepted").otherwise("quarantined"))
    return routed.writeStream.format("parquet").partitionBy("fate").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
