"""Document fingerprints by SimHash, in DataFrame functions only.

Every word votes with its weight, the square of its length, on 128 signed bits: the two 64-bit
hashes of the word. Two votes travel in one long. Fingerprints within a Hamming radius are found
by permuted block tables: cut into radius + 1 blocks, two such fingerprints agree in one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyframe.llm.common import drop_written, salted_join, table, text_or_empty, written

BITS = 128
#: Fingerprints that differ in up to so many bits are near.
RADIUS = 3
LONGEST = 16
_LANE = (1 << 32) - 1


def word_votes() -> list[Column]:
    """Aggregates over rows with a column `word`: the total weight, and 64 sums of two 32-bit votes each."""
    w = F.pow(F.least(F.length("word"), F.lit(LONGEST)), 2).cast("long")
    a, b = F.xxhash64("word"), F.xxhash64(F.lit("b"), "word")
    out = [F.sum(w).alias("total")]
    for k in range(64):
        bit = F.shiftrightunsigned(a, k).bitwiseAND(1) + F.shiftleft(F.shiftrightunsigned(b, k).bitwiseAND(1), 32)
        out.append(F.sum(bit * w).alias(f"v{k}"))
    return out


def _majority(lane: int) -> Column:
    """The 64 bits of one lane that more than half of the weight sets."""
    bits = []
    for k in range(64):
        votes = F.col(f"v{k}").bitwiseAND(F.lit(_LANE)) if lane == 0 else F.shiftrightunsigned(F.col(f"v{k}"), 32)
        bits.append(F.when(votes * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:
        bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def fingerprint_words(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """`by` and the fingerprint's halves f0 and f1, for rows whose texts share the values of `by`.

    A text without words sets no bit. The sum of the squared word lengths of one text must stay
    below 2**31, which holds to 134 MB.
    """
    words = rows.select(*by, F.explode(F.split(F.col(text), r"[\x20\x09-\x0D]+")).alias("word"))
    votes = words.groupBy(*by).agg(*word_votes())
    return votes.select(*by, _majority(0).alias("f0"), _majority(1).alias("f1"))


def as_text(f0: Column, f1: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The share of equal bits."""
    return 1 - (F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))) / F.lit(float(BITS))


def neighbours(rows: DataFrame, key: str) -> DataFrame:
    """k, h, key, n, copies, next_k, next_h: each distinct (key, text hash) and the next one by descending key.

    The order is cut into ranges; a range ends with the first row of the one after it, the last
    range with the first row of all. Only one row per range comes together.
    """
    distinct = rows.groupBy("k", "h", key, "n").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col(key).desc_nulls_last(), F.col("h")]
    ranged = written(distinct.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("part").orderBy(*order)
    first = ranged.withColumn("at", F.row_number().over(here)).filter("at = 1")
    parts = Window.orderBy("part")
    entry = F.struct("k", "h")
    after = first.select("part", F.coalesce(F.lead(entry).over(parts), F.first(entry).over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    led = ranged.withColumn("next", F.lead(entry).over(here)).join(F.broadcast(after), "part")  # a row per range
    return led.withColumn("next", F.coalesce("next", "after")).select("k", "h", key, "n", "copies", F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h"))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", queries: Column | None = None, radius: int = RADIUS) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    With queries, a condition on the key, also near_prints: for each row that meets it, how many
    other distinct fingerprints of the table lie within the radius (null for all other rows).

    The edited text is the text with its last third replaced by the start of the next document,
    in order of descending key, null last, then text hash; after the last comes the first, so a
    single document follows itself. A null text counts as empty; a text without words has an
    all-zero fingerprint, and two such are alike. Repeated rows are one document in that order and
    get one result row each. An empty table gives an empty result.
    """
    value = text_or_empty(F.col(text))
    rows = df.select(F.col(key), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.xxhash64(value).alias("h"), value.alias("t"))
    links = written(neighbours(rows.select("k", "h", key, F.length("t").cast("long").alias("n")), key), "next")
    # each text goes once through the shuffle, for itself and for the document before it
    one = Window.partitionBy("k", "h").orderBy("k")
    texts = rows.select("k", "h", "t").withColumn("copy", F.row_number().over(one)).filter("copy = 1").drop("copy")
    wanted = links.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n") / 3).alias("many"))
    starts = texts.join(wanted, ["k", "h"]).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.substring(F.col("t"), F.lit(1), F.col("many").cast("int")).alias("start"))
    both = texts.join(links, ["k", "h"]).join(starts, ["k", "h"])
    edited = F.concat(F.substring(F.col("t"), F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int")), F.col("start"))
    both = both.select("k", "h", key, "n", "copies", "next_k", "next_h", "t", edited.alias("edited"))
    by = ["k", "h", key, "n", "copies", "next_k", "next_h", "sha", "kind"]
    either = both.withColumn("sha", F.sha2("edited", 256)).withColumn("e", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("t").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))))
    either = either.select(*by[:-1], F.col("e.kind").alias("kind"), F.col("e.t").alias("t"))
    printed = fingerprint_words(either, by, "t")
    sides = [F.max(F.when(F.col("kind") == kind, F.col(f))).alias(f"{f}_{kind}") for kind in (0, 1) for f in ("f0", "f1")]
    done = written(printed.groupBy(*by[:-1]).agg(*sides), "fingerprints")
    drop_written(links)
    following = done.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("f0_0").alias("next_f0"), F.col("f1_0").alias("next_f1"))
    c = F.col
    out = done.join(following, ["next_k", "next_h"])
    more = []
    if queries is not None:
        prints = done.select(c("f0_0").alias("f0"), c("f1_0").alias("f1"))
        asked = done.filter(queries).select(c("f0_0").alias("f0"), c("f1_0").alias("f1"))
        found = within_radius(asked, prints, radius).groupBy("a0", "a1").agg((F.count(F.lit(1)) - 1).alias("near_prints"))
        found = found.select(c("a0").alias("f0_0"), c("a1").alias("f1_0"), "near_prints")
        rows = [out.filter(queries).join(found, ["f0_0", "f1_0"]), out.filter(~F.coalesce(queries, F.lit(False))).withColumn("near_prints", F.lit(None).cast("long"))]
        out, more = rows[0].unionByName(rows[1]), ["near_prints"]
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), c("copies"))))
    return out.select(
        key,
        c("n").alias("n_chars"),
        c("sha").alias("edited_sha256"),
        as_text(c("f0_0"), c("f1_0")).alias("fingerprint"),
        as_text(c("f0_1"), c("f1_1")).alias("edited_fingerprint"),
        likeness(c("f0_0"), c("f1_0"), c("f0_1"), c("f1_1")).alias("near_edited"),
        likeness(c("f0_0"), c("f1_0"), c("next_f0"), c("next_f1")).alias("near_next"),
        *more,
    )


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a0, a1, b0, b1, distance: the distinct fingerprints of `prints` within the radius of each distinct one of `queries`.

    Both have the halves f0 and f1 (see fingerprints; rows with equal fingerprints are one class,
    so copies aren't expanded). A fingerprint is entered in radius + 1 tables, each with another
    block of its bits in front; two fingerprints that differ in at most radius bits meet in the
    table of a block they share, and are reported from the first such table only. Nulls meet nothing.
    """
    if not 0 <= radius < 8:
        raise ValueError("the radius must be 0 to 7")
    blocks = radius + 1
    ends = [BITS * k // blocks for k in range(blocks + 1)]

    def block(k: int, f0: str, f1: str) -> Column:
        parts = []
        for half, f in ((0, f0), (64, f1)):
            low, high = max(ends[k], half) - half, min(ends[k + 1], half + 64) - half
            if low < high:
                mask = (1 << (high - low)) - 1
                mask = mask - (1 << 64) if mask >= 1 << 63 else mask
                parts.append(F.shiftrightunsigned(F.col(f), low).bitwiseAND(F.lit(mask)))
        return F.array(*[F.coalesce(p, F.lit(0)) for p in parts + [F.lit(0).cast("long")] * (2 - len(parts))])

    def tables(df: DataFrame, a: str, b: str) -> DataFrame:
        distinct = df.filter("f0 is not null and f1 is not null").select(F.col("f0").alias(a), F.col("f1").alias(b)).distinct()
        return distinct.select(a, b, F.posexplode(F.array(*[block(k, a, b) for k in range(blocks)])).alias("number", "block"))

    x, y = tables(queries, "a0", "a1"), written(tables(prints, "b0", "b1"), "block-tables")
    distance = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    earlier = reduce(lambda p, q: p | q, [(F.col("number") > k) & (block(k, "a0", "a1") == block(k, "b0", "b1")) for k in range(blocks - 1)], F.lit(False))
    # the fingerprints of a hot block are dealt over tasks, to each of which the queries with that block go
    met = salted_join(y, x, ["number", "block"], "b0").filter((distance <= radius) & ~earlier)
    return met.select("a0", "a1", "b0", "b1", distance.cast("int").alias("distance"))


def op10_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), queries=F.col("doc_id") % 50 == 0)
