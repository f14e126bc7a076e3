"""Streams of point tables: components never cross images, so each micro-batch of whole images stands alone (§2.18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import cluster


def cluster_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, anchor_area: float, radius: float, cap: float) -> StreamingQuery:
    """Files of points to cluster tables; a batch replaces its own folder, so a restart repeats it without harm."""

    def write(batch: DataFrame, number: int) -> None:
        cluster.cluster_features(cluster.anchor_cluster(batch, anchor_area, radius, cap)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and mean values of event windows; rows later than the watermark are dropped in streams."""
    at = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return at.groupBy(F.window("t", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
