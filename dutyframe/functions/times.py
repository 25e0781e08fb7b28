"""Duty hours read from text, as native expressions. A range is struct(start, end, ends_next_day), times as minutes of the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dutyframe.functions.text import let, strip_accents_upper

# Dashes that separate the two ends of a range, and the words for parts of the day.
DASHES = "-‐–—−"
MORNING, NIGHT, AFTERNOON, NEXT_DAY = "ΠΡΩΙ", ("ΒΡΑΔΥ", "ΝΥΧΤΑ"), ("ΜΕΣΗΜΕΡΙ", "ΑΠΟΓΕΥΜΑ"), "ΕΠΟΜΕΝΗΣ"


def _minutes(text: Column) -> Column:
    """One end of a range, already folded. A clock time that isn't valid rejects the end, hours with a part of the day or not."""
    clock = r"([0-9]{1,2})[:.]([0-9]{2})"
    number = lambda pattern, k: F.regexp_extract(text, pattern, k).try_cast("int")
    night = text.contains(NIGHT[0]) | text.contains(NIGHT[1])
    day = text.contains(AFTERNOON[0]) | text.contains(AFTERNOON[1])
    morning = text.contains(MORNING)

    def spoken(bare: Column) -> Column:
        hours = F.when((morning | night) & (bare == 12), 0).when(~morning & (night | day) & (bare < 12), bare + 12).otherwise(bare)
        return let(hours, lambda h: F.when(h < 24, h * 60))

    def told(hour: Column) -> Column:
        minute = lambda: let(number(clock, 2), lambda m: F.when((hour < 24) & (m < 60), hour * 60 + m))
        return F.when(hour.isNotNull(), minute()).otherwise(let(number(r"([0-9]{1,2})", 1), spoken))

    return let(number(clock, 1), told)


def parse_segment(folded: Column) -> Column:
    """start - end of folded text; overnight if the right side says so or the end isn't after the start."""
    cut = rf"(?s)^([^{DASHES}]*)[{DASHES}](.*)$"
    sides = let(folded, lambda t: F.when(t.rlike(f"[{DASHES}]"), F.struct(F.regexp_extract(t, cut, 1).alias("left"), F.regexp_extract(t, cut, 2).alias("right"))))
    ends = let(sides, lambda s: F.struct(_minutes(s["left"]).alias("start"), _minutes(s["right"]).alias("end"), s["right"].contains(NEXT_DAY).alias("next")))
    whole = lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), (e["next"] | (e["end"] <= e["start"])).alias("ends_next_day"))
    return let(ends, lambda e: F.when(e["start"].isNotNull() & e["end"].isNotNull(), whole(e)))


def parse_range(text: Column) -> Column:
    return parse_segment(strip_accents_upper(text))


def parse_ranges(text: Column) -> Column:
    """All windows of a shift in the order written; unreadable ones are left out. Null text: none."""
    parts = F.split(strip_accents_upper(F.coalesce(text, F.lit(""))), "[&,]| ΚΑΙ ")
    return F.filter(F.transform(parts, parse_segment), lambda r: r.isNotNull())


def on_day(window: Column, day: Column) -> Column:
    """struct(starts_at, ends_at) of a range on a day, as civil timestamps."""
    at = lambda d, m: F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), F.floor(m / 60).cast("int"), m % 60, F.lit(0).cast("decimal(8,6)"))
    last = F.when(window["ends_next_day"], F.date_add(day, 1)).otherwise(day)
    return F.when(window.isNotNull() & day.isNotNull(), F.struct(at(day, window["start"]).alias("starts_at"), at(last, window["end"]).alias("ends_at")))
