"""Nearest places for many points at once, by cells of a space-filling curve.

The world is cut into 2**LEVEL x 2**LEVEL cells of longitude and latitude, numbered along a Morton curve, so that
four neighbours of a level are one cell of the level above: its number is theirs without the last two bits. Points look in the nine cells around
them, first in small ones; those that can't be sure of their nearest places look again in cells four times as wide. Points that are far from all places
then go the other way, from the whole world down, and of the cells with places keep those that may hold a nearest one. No pair of a far point and place is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyframe.functions.geo import EARTH_KM, distance_km
from dutyframe.operators.tables import written

LEVEL = 16
#: Levels by which a round's cells are wider than those of the round before.
STEP = 2
#: Points that are not settled in cells of this level are far.
FAR = 2
#: Kilometres by which distances may be wrong, near the antipodes most of all.
SLACK_KM = 0.01
#: Distances are compared to the millimetre.
DIGITS = 6


def _spread(v: Column) -> Column:
    """The low 16 bits of v, a zero after each."""
    v = v.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _axis(value: Column, low: float, span: float) -> Column:
    """The number of the strip that a coordinate lies in."""
    return F.least(F.greatest(F.floor((value - low) / span * (1 << LEVEL)), F.lit(0)), F.lit((1 << LEVEL) - 1)).cast("long")


def cell(lat: Column, lon: Column) -> Column:
    """The Morton number of a point's smallest cell; null without coordinates. Tables sorted by it keep near places in one row group."""
    return _spread(_axis(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(_axis(lat, -90.0, 180.0)), 1))


def cell_range(south: float, north: float, west: float, east: float) -> tuple[int, int]:
    """The smallest and the largest cell of a box: as literals they reach the scan of a table that is sorted by cell."""

    def number(lat: float, lon: float) -> int:
        x, y = (min(max(int((v - low) / span * (1 << LEVEL)), 0), (1 << LEVEL) - 1) for v, low, span in ((lon, -180, 360), (lat, -90, 180)))
        return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(LEVEL))

    return number(south, west), number(north, east)


def in_box(places: DataFrame, south: float, north: float, west: float, east: float, column: str = "cell") -> DataFrame:
    """places (lat, lon and their cell) within a box; a row group without a cell of the box's range isn't read."""
    low, high = cell_range(south, north, west, east)
    return places.filter(F.col(column).between(low, high) & F.col("lat").between(south, north) & F.col("lon").between(west, east))


def nearest(points: DataFrame, places: DataFrame, k: int, key: str = "id", place: str = "id") -> DataFrame:
    """point, rank, place, distance_km: the k nearest places of each point, all of them where there are fewer.

    points: key, lat, lon; places: place, lat, lon; keys are unique. Rows without coordinates, or with
    impossible ones, are left out. Of places at one distance (to the millimetre) the smaller key comes first. Places at one spot are one candidate
    until the end, k of them at most, so a spot with very many places costs no more than others.
    """
    real = (F.col("lat").between(-90, 90)) & (F.col("lon").between(-180, 180))
    ranked = Window.partitionBy("lat", "lon").orderBy("place")
    spots = places.filter(real).select(F.col(place).alias("place"), "lat", "lon")
    counted = spots.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    lone = spots.join(counted.filter("n = 1").select("lat", "lon"), ["lat", "lon"], "left_semi").withColumn("at", F.lit(1))
    shared = spots.join(counted.filter("n > 1").select("lat", "lon"), ["lat", "lon"], "left_semi").withColumn("at", F.row_number().over(ranked)).filter(F.col("at") <= k)
    spots = written(lone.unionByName(shared).select("place", "lat", "lon", cell(F.col("lat"), F.col("lon")).alias("cell")).sortWithinPartitions("cell"), "spots")
    wanted = min(k, spots.limit(k).count())
    x, y = _axis(F.col("lon"), -180.0, 360.0), _axis(F.col("lat"), -90.0, 180.0)
    asked = written(points.filter(real).select(F.col(key).alias("__key"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "asked")
    # points at one spot look once
    left = written(asked.select("p_lat", "p_lon").distinct().withColumn("point", F.monotonically_increasing_id()), "points")
    left = left.select("point", "p_lat", "p_lon", _axis(F.col("p_lon"), -180.0, 360.0).alias("x"), _axis(F.col("p_lat"), -90.0, 180.0).alias("y"))
    done, empty = None, wanted == 0
    for level in range(0, FAR + STEP, STEP):
        size = LEVEL - level  # 2**size strips each way
        side = 1 << size
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        own_x, own_y = F.shiftright("x", level), F.shiftright("y", level)
        windows = left.withColumn("d", around).withColumns({"wx": F.pmod(own_x + F.col("d.i"), F.lit(side)), "wy": own_y + F.col("d.j")}).filter(f"wy between 0 and {side - 1}")
        windows = windows.withColumn("window", _spread(F.col("wx")).bitwiseOR(F.shiftleft(_spread(F.col("wy")), 1))).dropDuplicates(["point", "window"])
        met = windows.join(spots.withColumn("window", F.shiftright("cell", 2 * level)), "window")
        km = F.round(distance_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")), DIGITS)
        best = F.slice(F.array_sort(F.collect_list(F.struct(km.alias("km"), F.col("place")))), 1, k)
        found = left.join(met.groupBy("point").agg(best.alias("best")), "point", "left")
        # what lies nearer than the border of the nine cells has been seen; a whole cell is between the point and it
        high, wide = 180.0 / side, 360.0 / side
        lat_km = F.lit(high) * (EARTH_KM * 3.141592653589793 / 180)
        pole = (90 - F.abs("p_lat")) * (EARTH_KM * 3.141592653589793 / 180)
        edge = (own_y <= 0) | (own_y >= side - 1)
        lon_km = F.lit(EARTH_KM) * F.asin(F.cos(F.radians("p_lat")) * F.sin(F.radians(F.lit(min(wide, 90.0)))))
        sure = F.lit(float("inf")) if size <= 1 else F.least(lat_km, lon_km, F.when(edge, pole).otherwise(lat_km))
        last = F.element_at("best", -1)["km"]
        found = written(found.withColumn("settled", F.coalesce((F.size("best") >= wanted) & (last + 10.0**-DIGITS < sure), F.lit(size <= 1))), "found")
        mine = found.filter("settled").select("p_lat", "p_lon", F.posexplode("best").alias("rank", "b"))
        done = mine if done is None else done.unionByName(mine)
        left = found.filter("not settled").select("point", "p_lat", "p_lon", "x", "y")
        if empty or left.isEmpty():
            break
    if not empty and not left.isEmpty():
        done = done.unionByName(_far(left, spots, k, wanted).select("p_lat", "p_lon", F.posexplode("best").alias("rank", "b")))
    out = asked.join(done, ["p_lat", "p_lon"])
    return out.select(F.col("__key").alias("point"), (F.col("rank") + 1).alias("rank"), F.col("b.place").alias("place"), F.col("b.km").alias("distance_km"))


def _far(left: DataFrame, spots: DataFrame, k: int, wanted: int) -> DataFrame:
    """left with best, its nearest places: level by level down, of the cells that hold places those that may hold a nearest one.

    A cell is told by one of its places and by how far the others are from it at most. The `wanted` nearest of those places bound how
    far a nearest place can be; a cell beyond that by more than its own reach holds none.
    """
    km = lambda a, b: distance_km(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon"))
    front = left.select("point", "p_lat", "p_lon", F.lit(0).cast("long").alias("within"))
    for level in range(LEVEL - STEP, -STEP, -STEP):
        mine = spots.withColumn("child", F.shiftright("cell", 2 * level))
        first = mine.groupBy("child").agg(F.min_by(F.struct("lat", "lon"), "place").alias("f")).select("child", F.col("f.lat").alias("c_lat"), F.col("f.lon").alias("c_lon"))
        told = mine.join(first, "child").groupBy("child", "c_lat", "c_lon").agg(F.max(km("", "c_")).alias("reach"))
        told = written(told.withColumn("within", F.shiftright("child", 2 * STEP)), "cells")
        met = front.join(F.broadcast(told) if level >= LEVEL // 2 else told, "within")  # 4 ** (LEVEL - level) cells at most
        seen = met.groupBy("point", "p_lat", "p_lon").agg(F.array_sort(F.collect_list(F.struct(km("p_", "c_").alias("km"), "child", "reach"))).alias("seen"))
        bound = F.coalesce(F.try_element_at("seen", F.lit(wanted))["km"], F.lit(float("inf")))
        kept = F.filter("seen", lambda c: c["km"] - c["reach"] <= F.col("bound") + SLACK_KM)
        front = seen.withColumn("bound", bound).select("point", "p_lat", "p_lon", F.explode(F.transform(kept, lambda c: c["child"])).alias("within"))
        front = written(front, "front")
    met = front.join(spots.withColumnRenamed("cell", "within"), "within")
    near = F.struct(F.round(km("p_", ""), DIGITS).alias("km"), F.col("place"))
    return met.groupBy("point", "p_lat", "p_lon").agg(F.slice(F.array_sort(F.collect_list(near)), 1, k).alias("best"))
