"""The landing zone: fetched bytes as files, read as a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(content):
    """Bytes as text; invalid UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def landed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """url (the file's path), sha256, content and fetched_at of each landed file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), F.sha2("content", 256).alias("sha256"), decode(F.col("content")).alias("content"), F.col("modificationTime").alias("fetched_at"))


def identity(url, form):
    """A document's name: its url, and its form where it has one."""
    return F.concat_ws("?", url, form)
