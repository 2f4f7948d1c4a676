"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str) -> None:
    """One Parquet table; fingerprints are columns of it."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    """A text report as one file in a folder that the cluster shares, printed as well."""
    print("\n".join(lines))
    spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)
