"""A folder of growing JSON-lines logs as a stream.

Writers rotate: a file is taken whole once it has its final name under the pattern (Spark's
file source remembers files, not offsets), so a log is renamed into the pattern when it is
closed. The stream's checkpoint holds what was read, and a batch that failed is read again,
so a line comes at least once; assembly drops what comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.sources import importers


def lines(spark: SparkSession, pattern: str, most_files: int = 1000, latest_first: bool = False) -> DataFrame:
    """Stream of lines (`value`) without container prefixes; most_files bounds what a trigger takes, which is the rate limit."""
    read = spark.readStream.format("text").option("maxFilesPerTrigger", most_files).option("latestFirst", latest_first)
    return importers.unwrapped(read.load(pattern))


def envelopes(spark: SparkSession, pattern: str, source: str = "filetail", most_files: int = 1000) -> DataFrame:
    """Stream of envelopes of the lines: spans and episodes, as the JSON-lines importer routes them."""
    return importers.routed(lines(spark, pattern, most_files), source)
