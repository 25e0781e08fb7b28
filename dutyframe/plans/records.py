"""Queries of the smaller rules over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.functions import dates
from dutyframe.operators import serve, store, update
from dutyframe.plans.catalog import query
from dutyframe.plans.roles import scratch
from dutyframe.sources import raw


@query("""
SELECT o_orderkey, CAST(d - 1 AS VARCHAR) AS first_day, CAST(d + 7 AS VARCHAR) AS last_day, CAST(d - (greatest(n, 1) - 1) AS VARCHAR) AS from_day, CAST(d AS VARCHAR) AS to_day
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 12 AS INT) AS n FROM orders)""")
def refresh_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling window of a refresh on each order's day, and a window of some days that ends there."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    o = o.withColumns({"r": dates.rolling_window(F.col("d")), "w": dates.window_ending(F.col("d"), (F.col("o_orderkey") % 12).cast("int"))})
    return o.select("o_orderkey", *[F.col(c).cast("string").alias(n) for c, n in (("r.first", "first_day"), ("r.last", "last_day"), ("w.first", "from_day"), ("w.last", "to_day"))])


@query("SELECT event_id, CAST(CAST(timezone('Europe/Athens', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS day FROM events")
def athens_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day it is in Athens at each event's instant."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", dates.athens_day(F.col("ts").cast("timestamp_ntz")).cast("string").alias("day"))


@query("SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '?p=' || page_id ELSE '' END AS identity, CASE WHEN page_id % 3 = 0 THEN 'prefer_cache' WHEN page_id % 2 = 0 THEN 'force' ELSE 'revalidate' END AS hint, CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method FROM pages")
def request_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a document is named, asked for and cached: by its form and by whether it changes."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("p="), "page_id")).alias("form"))
    hint = store.cache_hint(F.col("page_id") % 3 != 0, F.col("form").isNotNull())
    return update.requests(p).select("page_id", raw.identity(F.col("url"), F.col("form")).alias("identity"), hint.alias("hint"), "method")


@query("SELECT sha256(region.r_name || chr(10)) AS sha256, r_name || chr(10) AS content, CAST(1 AS BIGINT) AS files FROM region")
def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a landing zone, read as documents: one is landed for each region."""
    path = scratch(spark, "landing")
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("value"), F.col("r_regionkey").alias("part"))
    rows.repartition(5, "part").write.partitionBy("part").text(path)
    return raw.landed(spark, path, "*.txt").groupBy("sha256", "content").agg(F.count_distinct("url").alias("files"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON with their payload nested, read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("props").alias("payload"))
    back = F.from_json("json", "event_id long, event_type string, payload struct<k:long>")
    return serve.nested_payload(e).select(back.alias("b")).select("b.event_id", "b.event_type", "b.payload.k")


@query("SELECT CAST(count(*) AS BIGINT) AS count, min(r_name) AS first_name, max(CASE WHEN r_regionkey = 1 THEN 'plain text' ELSE '1' END) AS last_payload FROM region")
def counted_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of a reading query: a count and the rows as JSON; a payload that is no JSON stays text."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name", F.when(F.col("r_regionkey") == 1, "plain text").otherwise('{"k": 1}').alias("payload"))
    one = serve.response(r)
    payload = F.transform("results", lambda j: F.coalesce(F.get_json_object(j, "$.payload.k"), F.get_json_object(j, "$.payload.text"), F.get_json_object(j, "$.payload")))
    return one.select("count", F.array_min(F.transform("results", lambda j: F.get_json_object(j, "$.r_name"))).alias("first_name"), F.array_max(payload).alias("last_payload"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Pharmacists'' Association of Attica' WHEN 1 THEN 'Ministry of Health' END AS attribution FROM supplier")
def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the attribution of their source; none for a source that isn't known."""
    source = F.when(F.col("s_suppkey") % 3 == 0, "fsa-attica-pharmacies").when(F.col("s_suppkey") % 3 == 1, "moh-attica-hospitals").otherwise("elsewhere")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), source.alias("source_id"))
    return serve.with_attribution(rows).select("id", "attribution")
