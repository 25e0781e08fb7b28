"""Dates and revisions read from text written by people, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dutyframe.functions.text import fold, let, tokens

# Month names, genitive and nominative, and weekdays, folded.
MONTHS = [
    ("ΙΑΝΟΥΑΡΙΟΥ", "ΙΑΝΟΥΑΡΙΟΣ"),
    ("ΦΕΒΡΟΥΑΡΙΟΥ", "ΦΕΒΡΟΥΑΡΙΟΣ"),
    ("ΜΑΡΤΙΟΥ", "ΜΑΡΤΙΟΣ"),
    ("ΑΠΡΙΛΙΟΥ", "ΑΠΡΙΛΙΟΣ"),
    ("ΜΑΙΟΥ", "ΜΑΙΟΣ"),
    ("ΙΟΥΝΙΟΥ", "ΙΟΥΝΙΟΣ"),
    ("ΙΟΥΛΙΟΥ", "ΙΟΥΛΙΟΣ"),
    ("ΑΥΓΟΥΣΤΟΥ", "ΑΥΓΟΥΣΤΟΣ"),
    ("ΣΕΠΤΕΜΒΡΙΟΥ", "ΣΕΠΤΕΜΒΡΙΟΣ"),
    ("ΟΚΤΩΒΡΙΟΥ", "ΟΚΤΩΒΡΙΟΣ"),
    ("ΝΟΕΜΒΡΙΟΥ", "ΝΟΕΜΒΡΙΟΣ"),
    ("ΔΕΚΕΜΒΡΙΟΥ", "ΔΕΚΕΜΒΡΙΟΣ"),
]
WEEKDAYS = ["ΔΕΥΤΕΡΑ", "ΤΡΙΤΗ", "ΤΕΤΑΡΤΗ", "ΠΕΜΠΤΗ", "ΠΑΡΑΣΚΕΥΗ", "ΣΑΒΒΑΤΟ", "ΚΥΡΙΑΚΗ"]
NUMERALS = "ΑΒΓΔΕ"
FIRST_YEAR, LAST_YEAR = 1900, 2100
TYPOS = 2


def _valid(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers in text form; null out of the calendar or of the years."""
    made = F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return let(made, lambda d: F.when(d.between(F.make_date(F.lit(FIRST_YEAR), F.lit(1), F.lit(1)), F.make_date(F.lit(LAST_YEAR), F.lit(12), F.lit(31))), d))


def _parts(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    year, month, day = (F.regexp_extract(text, pattern, k) for k in order)
    return F.when(year != "", _valid(year, month, day))


def parse_iso(text: Column) -> Column:
    return _parts(text, r"(?:^|[^0-9])([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[^0-9]|$)", (1, 2, 3))


def parse_compact(text: Column) -> Column:
    return _parts(text, r"(?:^|[^0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?:[^0-9]|$)", (1, 2, 3))


def parse_numeric(text: Column) -> Column:
    return _parts(text, r"(?:^|[^0-9])([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})(?:[^0-9]|$)", (3, 2, 1))


def month_number(token: Column) -> Column:
    """1 to 12 for a month's name, an abbreviation of one month only, or the one month within two typos; else null."""
    no = F.lit(None).cast("int")
    names = F.array(*[F.array(*[F.lit(n) for n in pair]) for pair in MONTHS])
    exact = F.try_element_at(F.create_map(*[F.lit(x) for k, pair in enumerate(MONTHS, 1) for n in pair for x in (n, k)]), token)
    begins = F.transform(names, lambda pair: F.exists(pair, lambda n: n.startswith(token)))
    begun = let(begins, lambda b: F.when(F.size(F.filter(b, lambda x: x)) == 1, F.array_position(b, True).cast("int")))
    # a distance beyond TYPOS counts as one more than that
    typos = lambda n: F.nullif(F.levenshtein(n, token, TYPOS), F.lit(-1))
    away = F.transform(names, lambda pair: F.coalesce(F.array_min(F.transform(pair, typos)), F.lit(TYPOS + 1)))
    alone = lambda a, least: F.when((least <= TYPOS) & (F.size(F.filter(a, lambda d: d == least)) == 1), F.array_position(a, least).cast("int"))
    near = let(away, lambda a: let(F.array_min(a), lambda least: alone(a, least)))
    weekday = token.rlike("(?:" + "|".join(WEEKDAYS) + r")\z")
    return (
        F.when(token.rlike("[0-9]") | weekday, no)
        .when(exact.isNotNull(), exact)
        .when(F.length(token) < 3, no)
        .otherwise(F.coalesce(begun, F.when(F.length(token) >= 5, near)))
    )


def parse_words(text: Column) -> Column:
    """The first month name decides; the nearest day before it, the first year after it, or else the nearest before."""
    number = lambda w: F.when(w.rlike("^[0-9]{1,4}$"), w.try_cast("int"))
    is_day = lambda w: (F.length(w) <= 2) & number(w).between(1, 31)
    is_year = lambda w: (F.length(w) == 4) & number(w).between(FIRST_YEAR, LAST_YEAR)
    first = lambda words, fits: F.try_element_at(F.filter(words, lambda w: F.coalesce(fits(w), F.lit(False))), F.lit(1))

    def read(words: Column, months: Column, at: Column) -> Column:
        before = F.reverse(F.slice(words, 1, F.greatest(at - 1, F.lit(0))))
        after = F.slice(words, at + 1, F.size(words))
        return F.when(at > 0, _valid(first(F.concat(after, before), is_year), F.try_element_at(months, at).cast("string"), first(before, is_day)))

    at = lambda months: F.array_position(F.transform(months, lambda m: m > 0), True).cast("int")
    months = lambda words: F.transform(words, lambda w: F.coalesce(month_number(w), F.lit(0)))
    return let(tokens(fold(text)), lambda words: let(months(words), lambda ms: let(at(ms), lambda k: read(words, ms, k))))


def parse_date(text: Column) -> Column:
    """Machine-written forms first, then Greek words, then day/month/year."""
    return F.coalesce(parse_iso(text), parse_compact(text), parse_words(text), parse_numeric(text))


def parse_revision(text: Column) -> Column:
    """0 for an original; a correction's Greek numeral, before the word or else after it; 1 without one."""
    words = F.split(fold(text), " ")
    at = F.array_position(words, "ΟΡΘΗ").cast("int")
    value = lambda k: F.nullif(F.coalesce(F.array_position(F.array(*[F.lit(c) for c in NUMERALS]), F.get(words, k)), F.lit(0)).cast("int"), F.lit(0))
    marked = F.coalesce(F.when(at > 1, value(at - 2)), F.when(at > 0, value(at)), F.lit(1))
    return F.when(fold(text).contains("ΟΡΘΗ"), marked).otherwise(0)


def days_between(a: Column, b: Column) -> Column:
    """All days of a window, in order, whichever bound is given first."""
    return F.sequence(F.least(a, b), F.greatest(a, b), F.expr("interval 1 day"))


def in_window(day: Column, a: Column, b: Column) -> Column:
    """Undated rows are in every window."""
    return day.isNull() | day.between(F.least(a, b), F.greatest(a, b))


def athens_day(utc: Column) -> Column:
    """The day it is in Athens at an instant, given as civil time in UTC."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Athens"), utc))


def athens_today() -> Column:
    return athens_day(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"))


def rolling_window(today: Column) -> Column:
    """struct(first, last) of the refresh horizon: yesterday to seven days ahead."""
    return F.struct(F.date_sub(today, 1).alias("first"), F.date_add(today, 7).alias("last"))


def window_ending(last: Column, days: Column) -> Column:
    """struct(first, last) of a number of days up to a given one."""
    return F.struct(F.date_sub(last, F.greatest(days, F.lit(1)) - 1).alias("first"), last.alias("last"))
