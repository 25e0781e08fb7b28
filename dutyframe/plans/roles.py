"""The provided tables in the roles of the record model (no coordinates or Greek text there; points come from keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.operators.tables import scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as snapshots: a customer is a source, the order's year its day, the priority's digit the revision."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("string").alias("source_id"),
        F.concat(F.lit("order/"), F.col("o_orderkey")).alias("url"),
        F.year("o_orderdate").alias("published_year"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("revision"),
    )


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as properties of parts, published by orders."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_partkey").alias("entity_id"),
        F.col("l_orderkey").alias("snapshot_id"),
        F.to_date("l_shipdate").alias("on_date"),
        F.col("l_shipdate").alias("starts_at"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))).alias("ends_at"),
        F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int")).alias("payload"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as entities: the type's last word is the kind."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.lower(F.element_at(F.split("p_type", " "), -1)).alias("kind"), F.col("p_name").alias("name"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("name_folded"), F.col("p_brand").alias("municipality"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as entities with points spread around Athens by key."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.lit("pharmacy").alias("kind"), F.col("s_name").alias("name"), (37.9 + (F.col("s_suppkey") % 97) / 400.0).alias("lat"), (23.6 + (F.col("s_suppkey") % 89) / 300.0).alias("lon"))
