"""Left joins with a table of one row per key, whatever share of the rows one key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutyframe.llm import common


def lookup(big: DataFrame, keyed: DataFrame, on: list[str], count: str, rows: int) -> DataFrame:
    """big left-joined with keyed, which has one row for each value of `on` and in `count` its number of rows in big.

    rows: the rows of big, a written table. The rows of hot keys (common.HOT_SHARE keys at most) stay where they
    are and meet a broadcast row; all others are joined by shuffle. Rows with a null key meet nothing and
    aren't shuffled. `count` may exceed the true number; it isn't returned.
    """
    if rows <= common.HOT_ROWS:
        return big.join(keyed.drop(count), on, "left")
    hot = F.col(count) > common.hot_limit(rows)
    few = keyed.filter(hot).drop(count).withColumn("__hot", F.lit(True))
    met = big.join(F.broadcast(few), on, "left")
    void = F.lit(False)
    for column in on:
        void = void | F.col(column).isNull()
    settled = F.col("__hot").isNotNull() | void
    rest = met.filter(~settled).select(*big.columns).join(keyed.filter(~hot).drop(count), on, "left")
    return met.filter(settled).drop("__hot").unionByName(rest)


def counted(big: DataFrame, keyed: DataFrame, on: list[str], rows: int, count: str = "__n") -> DataFrame:
    """keyed with its number of rows in big in `count`, where that is hot, else 0: what lookup asks for."""
    if rows <= common.HOT_ROWS:
        return keyed.withColumn(count, F.lit(0).cast("long"))
    hot = big.groupBy(*on).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > common.hot_limit(rows))
    return keyed.join(F.broadcast(hot), on, "left").fillna(0, [count])
