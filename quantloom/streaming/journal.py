"""The journal as a stream (an extension): late and repeated events are dropped under a watermark, each micro-batch is
appended only as far as it is new, so a replay after a failure changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.sources.sinks import journal_append


def as_journal(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("owner"), F.lit("events").alias("portfolio"), F.col("event_type").alias("kind"),
        F.col("event_id").cast("string").alias("record"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("ts"),
    )


def start(spark: SparkSession, source: str, target: str, checkpoint: str, delay: str = "10 minutes"):
    schema = spark.read.parquet(source).schema
    stream = as_journal(spark.readStream.schema(schema).parquet(source))
    fresh = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["owner", "kind", "record"]).drop("ts")
    sink = fresh.writeStream.foreachBatch(lambda batch, _: journal_append(batch.sparkSession, target, batch))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(spark: SparkSession, source: str, size: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Streaming counts and sums of events by type and event-time window."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
