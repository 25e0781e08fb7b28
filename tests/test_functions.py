"""The text, date, time and place rules, held against plain Python on drawn inputs."""

from __future__ import annotations

import datetime as dt
import html
import math
import random
import re
import unicodedata
import urllib.parse

import pytest
from pyspark.sql import functions as F

from dutyframe.functions import dates, geo, text, times

LETTERS = "αάβγδεέηήθιίϊΐκλοόπρσςτυύϋΰφχψωώΑΆΒΕΈΗΉΙΊΪΟΌΥΎΫΩΏ" + "abcXYZéèüñÇÅøß" + "0179" + "  .,-–«»()/'&<>\"\t"


def values(spark, inputs, f):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string").orderBy("k").select(f(F.col("x"))).collect()]


def drawn(seed, n, letters=LETTERS, longest=24):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(longest))) for _ in range(n)]


def bare(x):
    return "".join(c for c in unicodedata.normalize("NFD", x.upper()) if not unicodedata.combining(c)).upper()


def test_folds_equal_decomposition(spark):
    some = [*drawn(1, 300), None]
    folded = [None if x is None else " ".join("".join(c if c.isalnum() else " " for c in bare(x)).split()) for x in some]
    assert values(spark, some, text.strip_accents_upper) == [x if x is None else bare(x) for x in some] == values(spark, some, text.strip_accents_any)
    assert values(spark, some, text.fold) == folded
    assert values(spark, some, text.matching_key) == [x if x is None else x.replace(" ", "") for x in folded]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_edit_distance_up_to_a_limit(spark, limit):
    some = drawn(2, 40, "αβΓd", 7)
    pairs = [(a, b) for a in some for b in some[:12]]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.edit_distance_within(F.col("a"), F.col("b"), limit).alias("d")).collect()
    assert {(r["a"], r["b"], r["d"]) for r in got} == {(a, b, d if (d := distance(a, b)) <= limit else None) for a, b in pairs}


def test_white_space_runs_encodings(spark):
    some = drawn(3, 200, LETTERS + "\n  ", 30)
    assert values(spark, some, text.collapse) == [" ".join(re.split(r"[\s\u0085]+", x)).strip() for x in some]
    assert values(spark, some, text.tokens) == [re.findall(r"[0-9]+|[^0-9 \t\n\r\f\v]+", x) for x in some]
    assert values(spark, some, text.html_escape) == [html.escape(x).replace("&#x27;", "'") for x in some]
    assert values(spark, some, text.form_encode) == [urllib.parse.quote_plus(x, safe="~") for x in some]
    assert values(spark, ["".join(chr(0xF000 + ord(c)) for c in "Wing 7~")], text.unmap_symbols) == ["Wing 7~"]


def days(seed, n):
    r = random.Random(seed)
    return [dt.date(1900, 1, 1) + dt.timedelta(days=r.randrange(73_000)) for _ in range(n)]


def spoken(d, r):
    genitive, nominative = dates.MONTHS[d.month - 1]
    month = r.choice([genitive, nominative, genitive[: len(genitive) - 3] if d.month not in (5, 6, 7) else genitive, genitive.lower(), genitive[:5] + "Ω" + genitive[5:] if d.month not in (5, 6, 7) else genitive])
    parts = [r.choice([dates.WEEKDAYS[d.weekday()], "", "πρόγραμμα"]), str(d.day), month, str(d.year)]
    return r.choice([" ", "  ", ", ", "-"]).join(p for p in parts if p)


def test_written_days_are_read_back(spark):
    r = random.Random(4)
    told = [(f(d), d) for d in days(5, 150) for f in (str, lambda d: f"x{d:%Y%m%d}y", lambda d: f"({d.day}.{d.month}.{d.year})", lambda d: f"{d:%d/%m/%Y}", lambda d: spoken(d, r))]
    assert values(spark, [w for w, _ in told], dates.parse_date) == [d for _, d in told]


@pytest.mark.parametrize("nothing", [None, "", "Εφημερίες", "2023-02-29", "20230230", "0/5/2024", "32/1/2024", "ΤΡΙΤΗ ΜΑΙΟΥ 2024", "5 ΙΟΥ 2024", "1 ΜΑΙΟΥ 1899", "1/1/2101", "123456789", "ΠΑΡΑΣΚΕΥΗ 3 2024"])
def test_no_day_in(spark, nothing):
    assert values(spark, [nothing], dates.parse_date) == [None]


def test_months_within_two_typos(spark):
    r = random.Random(6)
    names = [n for pair in dates.MONTHS for n in pair]
    some = sorted({n[:k] + r.choice(["", "Ξ", "ΞΞ"]) + n[k + r.randrange(3) :] for n in names for k in range(len(n))})

    def month(token):
        if any(token.endswith(w) for w in dates.WEEKDAYS):
            return None
        near = [min(distance(n, token) for n in pair) for pair in dates.MONTHS]
        begun = [k for k, pair in enumerate(dates.MONTHS, 1) if any(n.startswith(token) for n in pair)]
        exact = [k for k, pair in enumerate(dates.MONTHS, 1) if token in pair]
        if exact or len(token) < 3:
            return exact[0] if exact else None
        if len(begun) == 1:
            return begun[0]
        return near.index(min(near)) + 1 if len(token) >= 5 and min(near) <= 2 and near.count(min(near)) == 1 else None

    assert values(spark, some, dates.month_number) == [month(t) for t in some]


def test_revisions_by_numeral(spark):
    told = [("χωρίς διόρθωση Β", 0)] + [(f"μέρα {before} {word} {after}", n) for word in ("ΟΡΘΗ", "ορθή") for before, after, n in [("", "", 1), ("Β΄", "", 2), ("", "Ε.", 5), ("Δ", "Α", 4), ("Ζ", "Γ", 3), ("Ζ", "Η", 1)]] + [("ΑΝΟΡΘΗ Β", 1)]
    assert values(spark, [x for x, _ in told], dates.parse_revision) == [n for _, n in told]


def test_shifts_are_read_back(spark):
    r = random.Random(8)
    told = []
    for _ in range(120):
        a, b = r.randrange(1440), r.randrange(1440)
        dash, dot = r.choice("-–—−"), r.choice(":.")
        next_day = r.random() < 0.3
        told.append((f"{a // 60}{dot}{a % 60:02} {dash} {b // 60:02}{dot}{b % 60:02}{' επομένης' if next_day else ''}", (a, b, next_day or b <= a)))
    for h in range(1, 12):
        told += [(f"{h} το πρωί - {h} μεσημέρι", (h * 60, h * 60 + 720, False)), (f"{h} ΑΠΟΓΕΥΜΑ–{h} ΝΥΧΤΑ", (h * 60 + 720, h * 60 + 720, True))]
    told += [("12 νύχτα - 12 μεσημέρι", (0, 720, False)), ("24:10 - 3", None), ("7:60 – 9", None), ("25 - 3", None), ("7 έως 9", None), (" - ", None)]
    assert [w and tuple(w) for w in values(spark, [x for x, _ in told], times.parse_range)] == [w for _, w in told]
    several = [(told[k], told[k + 1]) for k in range(0, 60, 2)]
    joined = [f"{a[0]} {r.choice(['&', ',', 'και'])} {b[0]}" for a, b in several]
    assert [[tuple(w) for w in s] for s in values(spark, joined, times.parse_ranges)] == [[a[1], b[1]] for a, b in several]
    assert values(spark, [None, "", "x & 9:00 - 8", "με τηλέφωνο"], lambda c: F.size(times.parse_ranges(c))) == [0, 0, 1, 0]


def test_windows_on_a_day(spark):
    day = dt.date(2024, 2, 28)
    at = lambda minutes: dt.datetime(2024, 2, 28) + dt.timedelta(minutes=minutes)
    got = values(spark, ["6:05 - 20:30", "20:30 - 6:05", "0:00 - 0:00", "x"], lambda c: times.on_day(times.parse_range(c), F.lit(day)))
    assert [g and tuple(g) for g in got] == [(at(365), at(1230)), (at(1230), at(1440 + 365)), (at(0), at(1440)), None]
    assert values(spark, ["6:05 - 20:30"], lambda c: times.on_day(times.parse_range(c), F.lit(None).cast("date"))) == [None]


def test_points_are_read_back(spark):
    r = random.Random(9)
    some = [(round(r.uniform(-99, 99), 5), round(r.uniform(-199, 199), 5)) for _ in range(80)]
    fits = [(a, b) if abs(a) <= 90 and abs(b) <= 180 else None for a, b in some]
    links = [f"/maps{r.choice('?&')}query={a}{r.choice([',', '%2C', '%2c'])}{b}{r.choice(['', '&z=1'])}" for a, b in some]
    assert [p and tuple(p) for p in values(spark, links, geo.point_of_map_link)] == fits
    assert [p and tuple(p) for p in values(spark, [f"Point({b} {a})" for a, b in some], geo.point_of_wkt)] == fits
    for read, nothing in ((geo.point_of_map_link, ["?q=1,2", "?query=1", "?query=a,b", "?query=,", ""]), (geo.point_of_wkt, ["POINT(1 2)", "Point(1,2)", "Point(1 2", "Point(1 2 3)", ""])):
        assert values(spark, nothing, read) == [None] * len(nothing)


def test_distances_and_boxes(spark):
    r = random.Random(10)
    some = [(r.uniform(-80, 80), r.uniform(-170, 170), r.uniform(-80, 80), r.uniform(-170, 170)) for _ in range(60)] + [(5.0, 6.0, 5.0, 6.0), (0.0, 0.0, 0.0, 180.0)]

    def cosines(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 6371 * math.acos(max(-1, min(1, math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d))))

    got = spark.createDataFrame(some, "a double, b double, c double, d double").select(geo.distance_km(*[F.col(x) for x in "abcd"])).collect()
    assert [g[0] for g in got] == pytest.approx([cosines(*s) for s in some], abs=1e-3)
    for lat, lon, km in ((38, 24, 1), (-60, 10, 30), (0, 0, 99)):
        south, north, west, east = geo.bounding_box(lat, lon, km)
        for turn in range(0, 360, 15):
            up, right = min(km, 50) * math.cos(math.radians(turn)) / 111.2, min(km, 50) * math.sin(math.radians(turn)) / (111.2 * math.cos(math.radians(lat)))
            assert south <= lat + up <= north and west <= lon + right <= east


def test_arguments():
    assert geo.read_point(" -1.5,2") == (-1.5, 2.0) and geo.read_date("2024-02-29") == dt.date(2024, 2, 29)
    for bad in ("", "1", "1;2", "x,y", "90.1,0", "0,180.5"):
        with pytest.raises(ValueError):
            geo.read_point(bad)
    for bad in ("", "29/2/2024", "2023-02-29"):
        with pytest.raises(ValueError):
            geo.read_date(bad)
