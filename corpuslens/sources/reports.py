"""Reports as JSON files, one document each; malformed ones stay as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, json): doc_id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("json"))
