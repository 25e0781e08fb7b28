"""Tables on the way to a result, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder of spark.checkpoint.dir; in local mode alone an own one, where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="dutyframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/records/{name}-{uuid.uuid4().hex}"


#: Of written tables: hashes in hexadecimal take half of what they do in Spark's default.
CODEC = "zstd"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, read again; its files outlive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: both sides are shuffled and sorted.

    Spark broadcasts what has few bytes in its files. Ids and dates that are all alike take a byte or two a row there, and hundreds of MB in the driver.
    """
    return df.hint("merge")
