"""Scans of keys that are cut into segments equal a walk over each key's rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dutyframe.operators import scan

SCHEMA = "k string, at int, id int, v int"


def drawn(seed, n=300):
    r = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None, "only"]
    return [(r.choice(keys), r.choice([None, *range(40)]), k, r.choice([None, *range(-9, 9)])) for k in range(n)]


def in_order(rows, keys=("k",)):
    """Each key's rows, nulls first."""
    out = defaultdict(list)
    for row in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        out[row[0] if keys else None].append(row)
    return out


@pytest.mark.parametrize("most", [10**6, 7, 1])
@pytest.mark.parametrize("how", ["sum", "min", "max", "last"])
@pytest.mark.parametrize("before", [False, True])
def test_running_values(spark, most, how, before):
    rows = drawn(1, 120)
    got = scan.Segments(spark.createDataFrame(rows, SCHEMA), ["k"], ["at", "id"], most).scan("r", F.col("v"), how, before).rows().collect()
    want = {}
    for own in in_order(rows).values():
        for k, row in enumerate(own):
            seen = [x[3] for x in own[: k + (not before)] if x[3] is not None]
            want[row[2]] = {"sum": sum, "min": min, "max": max, "last": lambda s: s[-1]}[how](seen) if seen else None
    assert {r["id"]: r["r"] for r in got} == want


@pytest.mark.parametrize(("keys", "most"), [(["k"], 10**6), (["k"], 5), ([], 20), ([], 10**6)])
def test_islands(spark, keys, most):
    rows = drawn(2)
    got = scan.islands(spark.createDataFrame(rows, SCHEMA), keys, ["at", "id"], lambda before: (F.col("at") - before("at") > 1) | (F.col("v") == before("v")), "g", most).collect()
    want = {}
    for own in in_order(rows, keys).values():
        g, last = 0, None
        for row in own:
            if last is None or None in (row[1], last[1]) and not (None not in (row[3], last[3]) and row[3] == last[3]):
                g += 1  # the first row, or a comparison with null
            elif None in (row[3], last[3]):
                g += 1 if row[1] - last[1] > 1 else 1  # true or null
            else:
                g += row[1] is not None and last[1] is not None and row[1] - last[1] > 1 or row[3] == last[3]
            want[row[2]], last = g, row
    assert {r["id"]: r["g"] for r in got} == want


@pytest.mark.parametrize(("keys", "most"), [(["k"], 10**6), (["k"], 4), ([], 9)])
def test_floor_join(spark, keys, most):
    points, marks = drawn(3, 150), [(k, at, n, v) for k, at, n, v in drawn(4, 90)]
    got = scan.floor_join(spark.createDataFrame(points, SCHEMA).drop("v"), spark.createDataFrame(marks, SCHEMA).select("k", F.col("at").alias("m"), "v").drop(*([] if keys else ["k"])), keys, "at", "m", "v", most)
    want = {}
    for k, at, n, _ in points:
        there = [(m is not None, m or 0, v) for key, m, _, v in marks if (not keys or key == k) and v is not None and (m is None or at is not None and m <= at)]
        want[n] = max(there)[2] if there else None
    assert {r["id"]: r["v"] for r in got.collect()} == want


@pytest.mark.parametrize(("keys", "most"), [(["k"], 10**6), (["k"], 6), ([], 11)])
@pytest.mark.parametrize("reach", [0, 1, 7, 100])
def test_anchored_groups(spark, keys, most, reach):
    """Reaches of each row's own, the shortest of ties; null places are in no group."""
    rows = drawn(5 + reach, 200)
    own_reach = lambda x: reach + (x[3] or 0) % 3
    df = spark.createDataFrame(rows, SCHEMA)
    extra = F.lit(reach) + F.pmod(F.coalesce("v", F.lit(0)), F.lit(3))
    got = scan.anchored_groups(df, keys, "at", F.col("at") + extra, "g", most).collect()
    want = {}
    for own in in_order(rows, keys).values():
        g, limit = 0, None
        for row in own:
            if row[1] is None:
                want[row[2]] = None
                continue
            if limit is None or row[1] > limit:
                g += 1
                limit = row[1] + min(own_reach(x) for x in own if x[1] == row[1])
            want[row[2]] = g
    assert len(got) == len(rows) and {r["id"]: r["g"] for r in got} == want


def test_rows_of_one_key_are_spread(spark):
    df = spark.range(4000).select(F.lit("x").alias("k"), F.col("id").cast("int").alias("at"), F.col("id").cast("int").alias("id"), F.lit(1).alias("v"))
    cut = scan.Segments(df, ["k"], ["at", "id"], 1000)
    sizes = [r["count"] for r in cut.df.groupBy(scan.SEGMENT).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2000
    assert cut.scan("r", F.col("v"), "sum").rows().agg(F.max("r")).first()[0] == 4000


def test_segments_do_not_grow_with_the_rows(spark):
    """A small `most` cuts a long key into SEGMENTS, not into one task for each `most` rows; beyond ROWS_IN_A_TASK rows each, more are cut."""
    df = spark.range(3000).select(F.col("id").cast("int").alias("at"))
    cut = scan.Segments(df, [], ["at"], 2)
    assert 1 < cut.df.agg(F.count_distinct(scan.SEGMENT)).first()[0] <= scan.SEGMENTS
    assert cut.scan("r", F.lit(1), "sum").rows().filter("r != at + 1").isEmpty()
    assert scan._ranges(10**9, 1000) == 10**9 // scan.ROWS_IN_A_TASK + 1 and scan._ranges(4000, 1000) == 5


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert scan.islands(df, ["k"], ["at"], lambda b: b("at") > 1, "g").isEmpty() and scan.anchored_groups(df, ["k"], "at", F.col("at"), "g").isEmpty()
    assert scan.floor_join(df.drop("v"), df.select("k", F.col("at").alias("m"), "v"), ["k"], "at", "m", "v").isEmpty()
