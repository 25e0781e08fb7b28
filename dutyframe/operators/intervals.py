"""Points in intervals by equality on bins, in place of comparing every point with every interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutyframe.operators.scan import Segments
from dutyframe.operators.tables import written

#: Bins of level k are 2**k wide.
LOWEST, HIGHEST = -20, 62


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str = "low", high: str = "high") -> DataFrame:
    """points with each interval that holds them (low <= at < high), within equal keys. at, low and high are numbers.

    An interval stands in the two bins at most that it touches of the level as wide as itself; a point looks in one bin of each
    level that there is. Intervals without an end at a side are cut where the points end. An empty interval, or
    one with a null bound, holds nothing; a null point is in none. Columns that both have, keys aside, would be ambiguous.
    """
    ends = points.agg(F.min(F.col(at).cast("double")).alias("a"), F.max(F.col(at).cast("double")).alias("b"))
    cut = intervals.join(F.broadcast(ends), F.lit(True)).withColumns({"__low": F.greatest(F.col(low).cast("double"), F.col("a")), "__high": F.least(F.col(high).cast("double"), F.col("b") + 1)})  # one row
    cut = cut.filter("a is not null and __low < __high").withColumn("__level", F.least(F.greatest(F.ceil(F.log2(F.col("__high") - F.col("__low"))), F.lit(LOWEST)), F.lit(HIGHEST)).cast("int"))
    touched = F.sequence(_bin(F.col("__low"), F.col("__level")), _bin(F.col("__high"), F.col("__level")))
    binned = written(cut.withColumn("__bin", F.explode(touched)).drop("a", "b", "__low", "__high"), "intervals")
    levels = sorted(r[0] for r in binned.select("__level").distinct().collect())  # HIGHEST - LOWEST + 1 at most
    if not levels:
        return points.join(binned.drop("__level", "__bin"), keys or F.lit(True), "inner").limit(0)
    spread = points.filter(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels])))
    spread = spread.withColumn("__bin", _bin(F.col(at).cast("double"), F.col("__level")))
    met = spread.join(binned, [*keys, "__level", "__bin"])
    return met.filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__level", "__bin")


def interval_totals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, sums: list[str], low: str = "low", high: str = "high", count: str = "n") -> DataFrame:
    """intervals that hold a point at least (low <= at < high, within equal keys), with how many they hold and the sums of these columns.

    No pair of a point and an interval is made: running totals over the places of points, met at the two bounds, tell what lies
    between. Sums are of whole numbers, which running totals keep exact. Bounds and points as in interval_join().
    """
    number = lambda c: F.col(c).cast("double")
    whole = [count, *sums]
    spots = points.filter(F.col(at).isNotNull()).groupBy(*keys, number(at).alias("__place")).agg(F.count(F.lit(1)).alias(count), *[F.sum(F.col(c).cast("long")).alias(c) for c in sums])
    asked = intervals.filter(number(low) < number(high))
    bounds = asked.select(*keys, F.explode(F.array(number(low), number(high))).alias("__place")).distinct()
    # at one place the bound comes before the points, so it is told what lies before it
    stream = bounds.withColumns({"__kind": F.lit(0), **{c: F.lit(None).cast("long") for c in whole}}).unionByName(spots.withColumn("__kind", F.lit(1)))
    told = Segments(written(stream, "bounds"), keys, ["__place", "__kind"])
    for c in whole:
        told = told.scan(f"__{c}", F.col(c), "sum")
    known = written(told.rows().filter("__kind = 0").select(*keys, "__place", *[F.coalesce(f"__{c}", F.lit(0)).alias(f"__{c}") for c in whole]), "totals")
    out = asked
    for side, bound in (("a", low), ("b", high)):
        own = known.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__place").alias("__at"), *[F.col(f"__{c}").alias(f"__{side}_{c}") for c in whole])
        same = number(bound) == F.col("__at")
        for k in keys:
            same = same & (F.col(k) == F.col(f"__k_{k}"))
        out = out.join(own, same).drop("__at", *[f"__k_{k}" for k in keys])
    totals = {c: F.col(f"__b_{c}") - F.col(f"__a_{c}") for c in whole}
    return out.withColumns(totals).drop(*[f"__{side}_{c}" for side in "ab" for c in whole]).filter(F.col(count) > 0)
