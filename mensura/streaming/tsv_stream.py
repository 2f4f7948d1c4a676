"""The wide TSV as a stream: the same stateless projection over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mensura.sources.delimited import wide_measurements


def stream_measurements(spark: SparkSession, folder: str, header: str, endpoint: str, family: dict[str, str], files_per_trigger: int = 64) -> DataFrame:
    """Streaming frame of the measurements in every text file of ``folder``; header lines are skipped wherever they stand."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return wide_measurements(lines, header, endpoint, family)


def land(measurements: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there to a Parquet table, exactly once across restarts, and stop."""
    return measurements.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
