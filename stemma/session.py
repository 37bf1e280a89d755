"""Session defaults. Settings that the cluster already has are kept."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE handles coalescing and skew; sizes are chosen so that a reduce task holds well under 1 GB.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "stemma") -> SparkSession:
    b = SparkSession.builder.appName(app).config(map=DEFAULTS)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
