"""The telemetry log as a stream: parsed events, windows, bursts of fallbacks. (The burst job is an extension.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = (
    "timestamp timestamp, event string, tool_name string, query string, hint_type string, route_match_type string, artifact_kind string, target_doc string, target_subsystem string, "
    "session_id string, brief_suggested boolean, brief_mode string"
)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a folder of JSON lines, queries cut at 200 characters."""
    return spark.readStream.schema(SCHEMA).json(folder).withColumn("query", F.left("query", F.lit(200)))


def match_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per window and match type; rows later than ``late`` are left out."""
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "route_match_type").agg(F.count(F.lit(1)).alias("events"))


def fallback_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", least: int = 3) -> DataFrame:
    """Sessions with at least ``least`` fallbacks: the agent searched on without a route."""
    marked = events.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap), "session_id")
    counted = marked.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("route_match_type") == "fallback").alias("fallbacks"))
    return counted.where(F.col("fallbacks") >= least)


def write_parquet(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends finished rows to parquet, exactly once; all that is there now is processed and the query ends."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
