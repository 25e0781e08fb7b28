"""Nearest places, substring search, points in intervals and the landing zone against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from dutyframe.operators import intervals, nearest, search
from dutyframe.sources import landing


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return round(2 * 6371 * math.asin(math.sqrt(min(1, h))), 6)


def spots(seed, n):
    """Clusters, lone places, shared spots, the poles and both sides of the date line."""
    r = random.Random(seed)
    centres = [(38, 23.7), (-89.9, 10), (89.99, -170), (0, 179.99), (0.001, -179.99), (60, -60)]
    out = []
    for k in range(n):
        lat, lon = r.choice(centres)
        spread = r.choice([0, 0.0005, 0.05, 3])
        lat, lon = max(-90.0, min(90.0, lat + r.uniform(-spread, spread))), lon + r.uniform(-spread, spread)
        out.append((k, round(lat, 6), round((lon + 180) % 360 - 180, 6)))
    return out


@pytest.mark.parametrize(("seed", "n", "k"), [(1, 150, 3), (2, 40, 1), (3, 2, 5), (4, 0, 2)])
def test_nearest_places(spark, seed, n, k):
    places, points = spots(seed, n), spots(seed + 50, 60) + [(900, 12.0, 100.0), (901, 90.0, 0.0)]
    schema = "id long, lat double, lon double"
    got = nearest.nearest(spark.createDataFrame([*points, (990, None, 1.0), (991, 95.0, 1.0)], schema), spark.createDataFrame([*places, (5000, None, None), (5001, 0.0, 200.0)], schema), k)
    want = sorted((p[0], rank, place, d) for p in points for rank, (d, place) in enumerate(sorted((km(p[1:], q[1:]), q[0]) for q in places)[:k], 1))
    assert [(r["point"], r["rank"], r["place"]) for r in got.orderBy("point", "rank").collect()] == [w[:3] for w in want]
    assert [r["distance_km"] for r in got.orderBy("point", "rank").collect()] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_cells_of_a_box(spark):
    rows = spark.createDataFrame(spots(7, 300), "id long, lat double, lon double").withColumn("cell", nearest.cell(F.col("lat"), F.col("lon")))
    for box in ((37, 39, 23, 24.5), (-90, -85, -180, 180), (-1, 1, 179, 180), (50, 51, 0, 1)):
        assert {r["id"] for r in nearest.in_box(rows, *box).collect()} == {r["id"] for r in rows.collect() if box[0] <= r["lat"] <= box[1] and box[2] <= r["lon"] <= box[3]}
    assert {r["cell"] for r in rows.collect()} == {nearest.cell_range(lat, lat, lon, lon)[0] for _, lat, lon in spots(7, 300)}


def test_many_needles(spark):
    r = random.Random(5)
    names = [(k, "".join(r.choice("ABΓ1") for _ in range(r.randrange(9)))) for k in range(200)] + [(900, None)]
    needles = [(k, "".join(r.choice("abγ1") for _ in range(r.randrange(6)))) for k in range(60)] + [(80, None), (81, "á Β"), (82, "zzz")]
    fold = lambda x: x.replace("á", "A").replace(" ", "").upper()
    got = search.search_many(spark.createDataFrame(names, "id long, name_folded string"), spark.createDataFrame(needles, "needle_id long, search string"))
    assert {tuple(x) for x in got.collect()} == {(n, i) for n, s in needles if s is not None for i, name in names if name is not None and fold(s) in name}
    assert got.count() == len(set(got.collect()))


def test_points_in_intervals(spark):
    r = random.Random(6)
    inf = float("inf")
    bounds = [(k, r.choice("ab"), low, low + r.choice([0, 0.001, 0.5, 1, 2, 30, 1000])) for k, low in enumerate(r.choice([-5, 0, 0.25, 3]) + r.random() * r.choice([0, 1, 40]) for _ in range(120))]
    bounds += [(500, "a", -inf, 1.0), (501, "a", 2.0, inf), (502, "b", -inf, inf), (503, "a", 3.0, 2.0), (504, "b", None, 2.0), (505, None, 0.0, 9.0)]
    points = [(k, r.choice("ab"), r.choice([b[2] for b in bounds[:120]] + [r.uniform(-9, 50)])) for k in range(150)] + [(900, "a", None), (901, None, 1.0)]
    p, b = spark.createDataFrame(points, "p long, k string, at double"), spark.createDataFrame(bounds, "i long, k string, low double, high double")
    inside = lambda x, y: None not in (x[2], y[2], y[3]) and y[2] <= x[2] < y[3]
    keyed = intervals.interval_join(p, b, ["k"], "at")
    assert sorted((x["p"], x["i"]) for x in keyed.collect()) == sorted((x[0], y[0]) for x in points for y in bounds if inside(x, y) and x[1] is not None and x[1] == y[1])
    free = intervals.interval_join(p, b.drop("k"), [], "at")
    assert sorted((x["p"], x["i"]) for x in free.collect()) == sorted((x[0], y[0]) for x in points for y in bounds if inside(x, y))
    assert "NestedLoop" not in free._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in free._jdf.queryExecution().executedPlan().toString()
    assert intervals.interval_join(p.limit(0), b, ["k"], "at").isEmpty() and intervals.interval_join(p, b.limit(0), ["k"], "at").isEmpty()


ANSWER = "method string, url string, form string, content string, fetched_at timestamp, etag string"


def at(day):
    return dt.datetime(2024, 1, day)


def test_landing_zone(spark, tmp_path):
    """Later answers, equal bodies, torn lines, missing bodies, answers without content or with too much; batch and stream agree."""
    zone = str(tmp_path / "zone")
    landing.land(spark.createDataFrame([("GET", "a", None, "one", at(1), None), ("GET", "b", None, "one", at(1), "e"), ("POST", "a", "q=1", "two", at(1), None), ("GET", "c", None, None, at(1), None)], ANSWER), zone)
    landing.land(spark.createDataFrame([("GET", "a", None, "newer", at(3), "f")], ANSWER), zone)
    landing.land(spark.createDataFrame([("GET", "a", None, "late, but older", at(2), None)], ANSWER), zone)
    key = spark.range(1).select(landing.cache_key(F.lit("GET"), F.lit("b"), F.lit(None).cast("string"))).first()[0]
    spark.createDataFrame([("{torn",), ('{"key": "x"}',), (f'{{"key": "{key}", "sha256": "{"f" * 64}", "fetched_at": "2025-01-01T00:00:00Z"}}',)], "value string").write.text(f"{zone}/meta/odd")
    want = {("GET", "a", None, "newer"), ("GET", "b", None, "one"), ("POST", "a", "q=1", "two")}
    assert {(r["method"], r["url"], r["form"], r["content"]) for r in landing.answers(spark, zone).collect()} == want
    handed = []
    keep = lambda rows, batch: handed.append({(r["url"], r["content"]) for r in rows.collect()})
    landing.stream_answers(spark, zone, keep, str(tmp_path / "check"), per_batch=1).awaitTermination()
    assert set().union(*handed) == {("a", "one"), ("b", "one"), ("a", "two"), ("a", "newer"), ("a", "late, but older")} and len(handed) > 2
    n = len(handed)
    landing.land(spark.createDataFrame([("GET", "d", None, "new", at(4), None)], ANSWER), zone)
    landing.stream_answers(spark, zone, keep, str(tmp_path / "check"), per_batch=9).awaitTermination()  # a restart
    assert set().union(*handed[n:]) == {("d", "new")}


@pytest.mark.parametrize(("policy", "landed", "dated", "action"), [
    ("cache_only", True, False, "hit"), ("cache_only", False, False, "miss"), ("prefer_cache", True, True, "hit"), ("prefer_cache", False, False, "fetch"), ("revalidate", True, True, "revalidate"),
    ("revalidate", True, False, "fetch"), ("revalidate", False, False, "fetch"), ("force", True, True, "fetch"), ("force", False, False, "fetch"), (None, True, False, "hit"), ("odd", False, False, "fetch"),
])
def test_request_plans(spark, tmp_path, policy, landed, dated, action):
    zone = str(tmp_path / "zone")
    landing.land(spark.createDataFrame([("GET", "a" if landed else "z", None, "x", at(1), "e" if dated else None)], ANSWER), zone)
    got = landing.plan(spark.createDataFrame([("GET", "a", None, policy)], "method string, url string, form string, policy string"), landing.answers(spark, zone)).first()
    assert (got["action"], got["content"]) == (action, "x" if landed else None)
