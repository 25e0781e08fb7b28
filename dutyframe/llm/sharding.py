"""Sharding by jump consistent hashing, in DataFrame functions only.

The jump walk needs no ring table: a linear congruential sequence seeded by the key gives the
next shard count at which the key would move, so growing from n to n + 1 shards moves about
1 / (n + 1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyframe.llm.common import HOT_ROWS, hot_limit, table, text_or_empty

#: Multiplier of the 64-bit generator of the published jump walk, as two halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK32, MASK16 = 0xFFFFFFFF, 0xFFFF
#: Bits of key_hash; blocks of a shard, each cut into as many parts as keep them at about BLOCK_ROWS rows.
HASH_BITS, BLOCKS, BLOCK_ROWS = 60, 256, 10_000
#: Starts of blocks up to this number are broadcast (one short row each); beyond it they are joined by shuffle.
BROADCAST_BLOCKS = 500_000


def key_hash(key: Column) -> Column:
    """60 stable bits of any key, from its text form (null as the empty text)."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """(state * MULTIPLIER + 1) mod 2**64 on two 32-bit halves; no product reaches 2**63."""
    first = low.bitwiseAND(MASK16) * LOW + 1
    second = F.shiftright(low, 16) * LOW
    bottom = first + F.shiftleft(second.bitwiseAND(MASK16), 16)
    carry = F.shiftright(bottom, 32) + F.shiftright(second, 16)
    crossed = F.shiftleft((F.shiftright(high, 16) * LOW).bitwiseAND(MASK16), 16) + high.bitwiseAND(MASK16) * LOW
    top = carry + (low * HIGH).bitwiseAND(MASK32) + crossed
    return top.bitwiseAND(MASK32), bottom.bitwiseAND(MASK32)


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among `shards` and among `shards + 1`."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    high, low = _next_state(F.shiftright(key, 32), key.bitwiseAND(MASK32))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("j"), zero.alias("shard"), zero.alias("grown"), high.alias("high"), low.alias("low"))

    def step(at: Column, _: Column) -> Column:
        high, low = _next_state(at["high"], at["low"])
        far = (at["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(at["high"], 1) + 1).cast("double"))
        moved = F.struct(
            F.floor(far).cast("long").alias("j"),
            F.when(at["j"] < shards, at["j"]).otherwise(at["shard"]).alias("shard"),
            at["j"].alias("grown"),
            high.alias("high"),
            low.alias("low"),
        )
        return F.when(at["j"] < shards + 1, moved).otherwise(at)

    # each step moves on by one shard at least, so shards + 1 steps end every walk
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(shards)),
        start,
        step,
        lambda at: F.struct(at["shard"].cast("int").alias("shard"), at["grown"].cast("int").alias("grown")),
    )


def shard_table(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its shard, its slot in the shard and its shard if one more is added.

    Returns key, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32, law, shard,
    slot, grown_shard, and the columns named in carry. Only the key and the shard count decide
    the shard. A null key is hashed as the empty text. Repeated rows get one slot each; rows that
    differ in nothing are interchangeable. An empty table gives an empty result.

    Slots: equal rows are counted before the shuffle, so a row repeated very often is one counted
    row; each shard is cut into blocks by key hash, as many as the rows ask for, whose counts give
    where each block's slots start. The rows of a hot key, with whatever texts, are blocks of their
    own, cut by the checksum of the text.
    """
    n_rows = df.count()
    cuts = max(1, math.ceil(n_rows / (shards * BLOCKS * BLOCK_ROWS)))
    value = text_or_empty(F.col(text))
    columns = [F.col(c) for c in carry]
    h = key_hash(F.col(key))
    rows = df.select(
        F.col(key).alias("__key"),
        (F.octet_length(value).cast("long") + 1).alias("__size"),
        F.crc32(value.cast("binary")).alias("__crc"),
        F.struct(*columns).alias("__carry") if carry else F.lit(0).alias("__carry"),
        h.alias("__hash"),
    )
    rows = rows.select("*", jump(F.col("__hash"), shards).alias("__at"))
    # blocks in the order of the hash modulo BLOCKS, then of the hash
    part = F.floor(F.shiftright("__hash", HASH_BITS - 30) * cuts / F.lit(float(1 << 30))).cast("long")
    block = F.pmod("__hash", F.lit(BLOCKS)) * cuts + part
    rows = rows.select("*", F.col("__at.shard").alias("__shard"), F.col("__at.grown").alias("__grown"), block.alias("__block"))
    # a hot hash cuts its block in three: the hashes below it, its own rows, which are cut further, and those above
    rows = rows.withColumns({"__sub": F.lit(0), "__part": F.lit(0).cast("long")})
    if n_rows > HOT_ROWS:
        limit = hot_limit(n_rows)
        hot = rows.groupBy("__block", "__hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
        entry = F.struct(F.col("__hash").alias("hash"), F.ceil(F.col("n") / limit).alias("parts"))
        hots = hot.groupBy("__block").agg(F.collect_list(entry).alias("__hots"))  # HOT_SHARE entries at most in all
        own = F.get(F.filter("__hots", lambda x: x["hash"] == F.col("__hash")), F.lit(0))["parts"]
        below = F.size(F.filter("__hots", lambda x: x["hash"] < F.col("__hash")))
        sub = F.when(F.col("__hots").isNull(), 0).otherwise(2 * below + own.isNotNull().cast("int"))
        part = F.coalesce(F.floor(F.col("__crc") * own / F.lit(float(1 << 32))), F.lit(0).cast("long"))
        rows = rows.join(F.broadcast(hots), "__block", "left").withColumns({"__sub": sub, "__part": part}).drop("__hots")
    within_shard = ["__block", "__sub", "__part"]
    named = ["__key", "__size", "__crc", "__carry", "__hash", "__shard", "__grown", *within_shard]
    counted = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("__copies"))
    per_block = rows.groupBy("__shard", *within_shard).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__shard").orderBy(*within_shard).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("__shard", *within_shard, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__shard", *within_shard).orderBy("__hash", "__key", "__crc", "__size", F.xxhash64("__carry")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__at", F.coalesce(F.sum("__copies").over(within), F.lit(0)))
    small = F.broadcast if shards * BLOCKS * cuts <= BROADCAST_BLOCKS else lambda x: x
    placed = placed.join(small(starts), ["__shard", *within_shard])
    placed = placed.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    return placed.select(
        F.col("__key").alias(key),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__shard").alias("shard"),
        (F.col("__start") + F.col("__at") + F.col("__copy")).alias("slot"),
        F.col("__grown").alias("grown_shard"),
        *[F.col("__carry")[c].alias(c) for c in carry],
    )


def op2_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"))


#: DuckDB has no crc32, so the oracle folds the bytes through the table of the reflected polynomial.
ORACLE = f"""
WITH RECURSIVE
bits AS (SELECT list(v ORDER BY i) AS crc_table FROM (
  SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
keyed AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hexed,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS HUGEINT) AS h FROM documents),
sums AS (
  SELECT rid, doc_id, h, CAST(length(hexed) // 2 + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
               list_transform(range(length(hexed) // 2), lambda i: CAST('0x' || substr(hexed, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
             lambda c, y: xor(crc_table[CAST(xor(c & 255, y) + 1 AS INT)], c // 256)), 4294967295) AS text_crc32
  FROM keyed, bits),
walk AS (
  SELECT rid, (h * {MULTIPLIER} + 1) % 18446744073709551616 AS state, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM keyed
  UNION ALL
  SELECT rid, (state * {MULTIPLIER} + 1) % 18446744073709551616, j,
         CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(state // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM walk WHERE j < 17),
placed AS (
  SELECT rid, max(j) FILTER (j < 16) AS shard, max(j) FILTER (j < 17) AS grown FROM walk GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY h % 256, h, doc_id, text_crc32) - 1 AS BIGINT) AS slot, CAST(grown AS INT) AS grown_shard
FROM sums JOIN placed USING (rid)
"""
