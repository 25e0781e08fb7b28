"""Names within a few edits of each other, met by shared parts instead of pair by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutyframe.functions.text import edit_distance_within

EDITS = 2
PARTS = EDITS + 1


def within_two_edits(names: DataFrame, column: str) -> DataFrame:
    """a, b, distance of all distinct names a < b at most two edits apart.

    Of the three parts that a name of three letters or more is cut into, two edits leave one whole,
    moved by two places at most: names meet by such a part and its place. Names of one or two
    letters are all within two edits of each other, and meet longer ones through the parts of these.
    """
    n, size = F.col("n"), F.length("n")
    distinct = names.select(F.col(column).alias("n")).filter("n is not null").distinct()
    cut = lambda k: F.floor(size * k / PARTS).cast("int")
    parts = F.array(*[F.struct((cut(k) + 1).alias("at"), F.substring(n, cut(k) + 1, cut(k + 1) - cut(k)).alias("part")) for k in range(PARTS)])
    own = distinct.filter(size >= PARTS).select(n.alias("a"), F.explode(parts).alias("p")).select("a", "p.*")
    # lengths that the parts of names two letters shorter to two letters longer have
    lengths = F.sequence(F.greatest(F.floor((size - EDITS) / PARTS), F.lit(1)).cast("int"), F.ceil((size + EDITS) / PARTS).cast("int"))
    spots = distinct.select(n.alias("b"), F.explode(lengths).alias("s")).filter(F.col("s") <= F.length("b"))
    spots = spots.select("b", "s", F.explode(F.sequence(F.lit(1), F.length("b") - F.col("s") + 1)).alias("bt"))
    other = spots.select("b", "bt", F.substring(F.col("b"), F.col("bt"), F.col("s")).alias("part"))
    met = own.join(other, "part").filter((F.abs(F.col("at") - F.col("bt")) <= EDITS) & (F.col("a") != F.col("b")))
    # both are short: every pair is a result
    short = distinct.filter(size < PARTS).select("n", F.lit(0).alias("all"))
    few = short.withColumnRenamed("n", "a").join(short.withColumnRenamed("n", "b"), "all").filter("a < b")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(few.select("a", "b")).distinct()
    return pairs.withColumn("distance", edit_distance_within(F.col("a"), F.col("b"), EDITS).cast("long")).filter("distance is not null")
