"""Writers for results; each replaces only what it owns, so a job that runs again leaves the same files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_csv(df: DataFrame, folder: str) -> None:
    """A delimited export with a header; quotes doubled as spreadsheet programs expect."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


def exported_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What export_csv wrote. A missing value is nothing between two separators and an empty text a pair of quotes; Spark takes
    both for null, unless null goes by a mark that no value has. The escape of the escape is NUL unless it is set, which takes NULs
    out of quoted texts."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("charToEscapeQuoteEscaping", '"')
    return rows.option("nullValue", uuid.uuid4().hex).schema(schema).csv(folder)


def export_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def export_text(df: DataFrame, column: str, folder: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(folder)


def replace_partitions(df: DataFrame, folder: str, key: str) -> None:
    """Overwrite only the partitions of keys that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by a join key, so later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
