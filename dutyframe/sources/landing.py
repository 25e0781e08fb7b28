"""The landing zone: answers to requests as pairs of a body and what is known about it, met by the key of their request.

Bodies are a table, and so is what is known about them, one JSON line for each answer. A body is written before its line; an answer counts
once its line can be read and its body is there, and is a miss until then. So a run that broke off leaves nothing that a later one would trust.
Everything is read and written by Spark, so the folder may be in any store that Spark reaches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.operators.store import cache_key
from dutyframe.operators.supersede import latest
from dutyframe.operators.tables import written

META = "key string, method string, url string, form string, sha256 string, fetched_at timestamp, etag string, last_modified string, content_type string"
BODY = "sha256 string, content string"
#: Characters of an answer's body; a longer one isn't landed.
MOST = 64 << 20


def land(answers: DataFrame, folder: str) -> None:
    """Write answers (method, url, form, content, fetched_at; etag, last_modified and content_type may be absent).

    An answer without content, or with too much of it, isn't landed. Equal bodies of one call are written once.
    """
    for column in ("etag", "last_modified", "content_type"):
        if column not in answers.columns:
            answers = answers.withColumn(column, F.lit(None).cast("string"))
    key = cache_key(F.col("method"), F.coalesce("url", F.lit("")), F.col("form"))
    good = answers.filter(F.octet_length("content") <= MOST).withColumns({"key": key, "sha256": F.sha2("content", 256)})
    batch = uuid.uuid4().hex
    good.select("sha256", "content").dropDuplicates(["sha256"]).write.parquet(f"{folder}/bodies/{batch}")
    names = [c.strip().split(" ")[0] for c in META.split(",")]
    good.select(F.to_json(F.struct(*names)).alias("value")).write.text(f"{folder}/meta/{batch}")


def _told(lines: DataFrame) -> DataFrame:
    """What the lines say; one that can't be read, or lacks its key or body's name, says nothing."""
    read = lines.select(F.from_json("value", META).alias("m")).select("m.*")
    return read.filter("key is not null and sha256 is not null and fetched_at is not null")


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BODY).option("recursiveFileLookup", "true").parquet(f"{folder}/bodies").dropDuplicates(["sha256"])


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """META and content: of each request the last answer whose body is there."""
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{folder}/meta")
    there = _told(lines).join(_bodies(spark, folder), "sha256")
    return latest(there, ["key"], ["fetched_at", "sha256"])


def stream_answers(spark: SparkSession, folder: str, each, checkpoint: str, per_batch: int = 1000):
    """Start handing answers (META and content) to each(rows, batch) as their lines land, in micro-batches.

    A line's body is there before it, so a batch reads the bodies of its own lines. Every answer is handed on once, older ones of a request too.
    """

    def pair(lines: DataFrame, batch: int) -> None:
        each(_told(lines).join(_bodies(spark, folder), "sha256"), batch)

    lines = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).text(f"{folder}/meta")
    return lines.writeStream.foreachBatch(pair).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def plan(requests: DataFrame, landed: DataFrame) -> DataFrame:
    """requests (method, url, form, policy) with key, what to do, and the last answer's content, sha256, fetched_at, etag and last_modified.

    action: `hit` (use the answer), `revalidate` (ask whether it still holds, by etag or date), `fetch`, or `miss`: nothing is
    landed and only what is landed may be used. Policies: cache_only, prefer_cache, revalidate, force; another one, or none, is prefer_cache.
    """
    keyed = requests.withColumn("key", cache_key(F.col("method"), F.coalesce("url", F.lit("")), F.col("form")))
    known = landed.select("key", "content", "sha256", "fetched_at", "etag", "last_modified", F.lit(True).alias("__there"))
    both = keyed.join(known, "key", "left")
    there, dated = F.col("__there").isNotNull(), F.coalesce("etag", "last_modified").isNotNull()
    policy = F.coalesce("policy", F.lit("prefer_cache"))
    action = (
        F.when(policy == "cache_only", F.when(there, "hit").otherwise("miss"))
        .when(policy == "force", "fetch")
        .when(policy == "revalidate", F.when(there & dated, "revalidate").otherwise("fetch"))
        .otherwise(F.when(there, "hit").otherwise("fetch"))
    )
    return both.withColumn("action", action).drop("__there")


def snapshot(landed: DataFrame, name: str = "landed") -> DataFrame:
    """The answers as they are now, as a table of their own, for a run that must not see later ones."""
    return written(landed, name)
