"""Structured Streaming over events: tumbling windows, sessions, and joins by availability.

The studies themselves are batch; these carry their rule, that a value counts only once it
is available, to streams: watermarks stand for release lags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """New Parquet files of a folder as a stream, under the schema of those there now."""
    pattern = f"{name}.parquet"
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each event type in windows; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: events with pauses under the gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def available(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "2 hours") -> DataFrame:
    """Left events with the right events of their key that were released up to `within` before them."""
    a = left.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).alias("a")
    b = right.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).alias("b")
    near = (F.col("b.ts") < F.col("a.ts")) & (F.col("b.ts") >= F.col("a.ts") - F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near).select(F.col(f"a.{key}").alias(key), F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("released_id"), F.col("a.ts").alias("ts"), F.col("b.ts").alias("released"))


def drained(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there into a table in memory, for tests."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
