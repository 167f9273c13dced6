"""Structured Streaming into the store: one commit for each micro-batch, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.codec import DELETE, PUT
from ..sources.store import Store


def staged(batch: DataFrame, order: str) -> DataFrame:
    """(raw_key, value, kind, seq) of a batch (raw_key, value, and a column that orders writes): the last write of each key."""
    w = Window.partitionBy("raw_key").orderBy(F.desc(order))
    last = batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    value = F.coalesce(F.col("value").cast("binary"), F.lit(b""))
    kind = F.when(F.length(value) == 0, DELETE).otherwise(PUT).cast("byte")
    return last.select(F.col("raw_key").cast("binary").alias("raw_key"), value.alias("value"), kind.alias("kind"), F.lit(0).alias("seq"))


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str, order: str = "commit_order", trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that commits each micro-batch under ``name:batch id``; a replayed batch changes nothing."""
    def commit(batch: DataFrame, batch_id: int) -> None:
        store.write_batch(staged(batch, order), name, batch_id)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
