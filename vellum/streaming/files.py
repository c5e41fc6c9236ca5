"""Arriving files as a stream: every table of ``plans.tables`` works on it, as each row is parsed on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def arriving_files(spark: SparkSession, path: str, pattern: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of files as they appear below ``path``; no state is kept beyond Spark's list of seen files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)
