"""Structured Streaming over the same parsers: links from a growing folder, and sessions of events.

An extra: the batch engine has no streams of its own to be measured against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemma.functions import refs as R


def links(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """source_verse, target_verse, votes, at of tab-separated lines in new files of a folder; malformed lines are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    c = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(c) >= 3)).select(
        R.normalize_verse(F.get(c, F.lit(0))).alias("source_verse"), R.normalize_verse(F.get(c, F.lit(1))).alias("target_verse"), F.regexp_extract(F.get(c, F.lit(2)), r"^\s*([+-]?\d+)", 1).try_cast("int").alias("votes"), F.current_timestamp().alias("at")
    )
    return rows.filter("source_verse is not null and target_verse is not null and votes > 0")


def unique_links(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of equal links within the watermark: state stays bounded."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["source_verse", "target_verse"])


def debounced(events: DataFrame, at: str, key: str, gap: str = "400 milliseconds", late: str = "10 minutes") -> DataFrame:
    """One row per burst of a key: events closer than ``gap`` count as one."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, until all that is there is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
