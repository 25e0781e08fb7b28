"""Substring search for many needles at once, through postings of short pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutyframe.functions.text import matching_key
from dutyframe.operators.tables import written

GRAM = 3
#: Ids that are handed on together, about.
LIST = 1000


def grams(column: str, size: int) -> F.Column:
    """The distinct pieces of `size` letters of a text."""
    c = F.col(column)
    starts = F.sequence(F.lit(1), F.length(c) - size + 1)
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(starts, lambda k: F.substring(c, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def search_many(entities: DataFrame, needles: DataFrame, column: str = "name_folded") -> DataFrame:
    """needle_id, id: the entities whose folded name holds the needle, for each needle.

    entities: id and the folded name; needles: needle_id, search (as typed; it is folded like names are). A null name or
    needle meets nothing; one that is empty once folded is in every name, as for a single search, and is paired with all of them.
    Each needle looks in the postings of its rarest piece only, and what it finds there is verified. Needles under GRAM letters
    are pieces themselves. Equal needles look once, and equal names are looked at once; the ids of both meet at the end, in lists of
    LIST ids at most, so that no pair of ids is shuffled.
    """
    typed = written(needles.select("needle_id", matching_key(F.col("search")).alias("needle")).filter("needle is not null"), "typed")
    named = written(entities.select("id", F.col(column).alias("name")).filter("name is not null"), "named")
    met = _meet(typed.select("needle").distinct().select(F.col("needle").alias("needle_id"), "needle"), named.select("name").distinct().select(F.col("name").alias("id"), "name"))
    both = met.select(F.col("needle_id").alias("needle"), F.col("id").alias("name"))
    both = both.join(_lists(typed, "needle", "needle_id", "__needles"), "needle").join(_lists(named, "name", "id", "__ids"), "name")
    # lists are few and what they make is much: they are dealt evenly over a stated number of tasks
    tasks = 4 * int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.select("__needles", "__ids").repartition(tasks)
    # generated code holds all rows that it makes of one row: with both lists in one piece of code a million, cut by a coalesce that joins nothing a thousand
    asked = both.select(F.explode("__needles").alias("needle_id"), "__ids").coalesce(tasks)
    return asked.select("needle_id", F.explode("__ids").alias("id"))


def _lists(df: DataFrame, by: str, key: str, out: str) -> DataFrame:
    """by and its keys in lists, as many for each as it takes."""
    sizes = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / LIST).alias("__n"))
    dealt = df.join(sizes, by).withColumn("__list", F.pmod(F.xxhash64(key), F.col("__n")))
    return dealt.groupBy(by, "__list").agg(F.collect_list(key).alias(out)).drop("__list")


def _meet(asked: DataFrame, names: DataFrame) -> DataFrame:
    """needle_id, id of distinct needles and the distinct names that hold them."""
    sizes = [r[0] for r in asked.filter("needle != ''").select(F.least(F.length("needle"), F.lit(GRAM)).alias("s")).distinct().collect()]  # 1 to GRAM
    everything = asked.filter("needle = ''").select("needle_id", F.lit(0).alias("size"), F.lit("").alias("gram"), "needle")
    pieces, postings = everything, None
    for size in sizes:
        pieces = pieces.unionByName(asked.filter(F.least(F.length("needle"), F.lit(GRAM)) == size).filter("needle != ''").select("needle_id", F.lit(size).alias("size"), F.explode(grams("needle", size)).alias("gram"), "needle"))
    pieces = written(pieces, "pieces")
    for size in sorted({0, *sizes}):
        own = names.select("id", "name", F.lit(size).alias("size"), F.explode(grams("name", size) if size else F.array(F.lit(""))).alias("gram"))
        own = own.join(pieces.filter(F.col("size") == size).select("gram").distinct(), "gram", "left_semi")
        postings = own if postings is None else postings.unionByName(own)
    postings = written(postings, "postings")
    counts = postings.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(counts, ["size", "gram"], "left").groupBy("needle_id", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "gram")).alias("r"))
    met = rarest.filter("r.n > 0").select("needle_id", "needle", "r.size", "r.gram").join(postings, ["size", "gram"])
    return met.filter(F.col("name").contains(F.col("needle"))).select("needle_id", "id")
