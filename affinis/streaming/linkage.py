"""Queries that arrive as files are matched batch by batch against targets prepared beforehand.

Each query is independent of the others, so there is no state; a batch is written once under
its number, and a batch that is repeated after a failure overwrites what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import blocking as B
from affinis.operators import profile as P
from affinis.operators import retrieval as R


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def match_stream(queries: DataFrame, targets: DataFrame, out: str, checkpoint: str, how: B.Blocking = B.DEFAULT, max_candidates: int = 25):
    """Starts a query that ranks candidates of each micro-batch. ``targets`` are staged profiles."""

    def rank_batch(batch: DataFrame, number: int) -> None:
        profiles = P.profile(batch.select("entity_id", "business_name", "business_address", "country")).persist()
        try:
            ranked = R.retrieve(profiles, targets, how, max_candidates)
            ranked.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            profiles.unpersist()

    return queries.writeStream.foreachBatch(rank_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and event type; rows later than the watermark are left out in a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
