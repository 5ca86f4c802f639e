"""Page views: validated ingest and daily rollups, on streams and on finished logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, ts long, path string, ref string"


def validated(rows: DataFrame, longest: int = 500) -> DataFrame:
    """Views with a path from the root, cut to `longest`; a missing time is now."""
    ok = F.coalesce((F.col("kind") == "pageview") & F.col("path").startswith("/"), F.lit(False))
    return rows.where(ok).select("kind", F.coalesce("ts", F.unix_millis(F.current_timestamp())).alias("ts"), F.substring("path", 1, longest).alias("path"), F.substring("ref", 1, longest).alias("ref"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines; blank and malformed lines and rows without kind, time or path are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where("kind is not null and ts is not null and path is not null")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return validated(spark.readStream.schema(SCHEMA).json(path))


def append(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends validated views as JSON lines, each once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def daily(views: DataFrame, late: str = "1 day") -> DataFrame:
    """Views by UTC day and path; on a stream, days close `late` after their end."""
    rows = views.withColumn("at", F.timestamp_millis("ts"))
    rows = rows.withWatermark("at", late) if views.isStreaming else rows
    return rows.groupBy(F.window("at", "1 day"), "path").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "path", "n")
