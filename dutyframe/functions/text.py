"""Text normalizing as native column expressions (Arrow only where Spark has no function: NFD)."""

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of modern Greek and of Latin-1 with marks, and the bare capitals they fold to.
ACCENTED = "ΆΈΉΊΌΎΏΪΫΑΐΰÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
PLAIN = "ΑΕΗΙΟΥΩΙΥΑΙΥAAAAAACEEEEIIIINOOOOOUUUUYY"
CONNECTORS = ["ΕΩΣ", "ΚΑΙ", "ΜΕΧΡΙ", "ΑΠΟ", ""]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_accents_upper(text: Column) -> Column:
    """Full upper case without marks, for precomposed Greek and Latin-1 letters; punctuation stays.

    Upper-casing ΐ and ΰ yields base letter plus combining marks, which go as well.
    """
    return F.translate(F.regexp_replace(F.upper(text), r"\p{Mn}+", ""), ACCENTED, PLAIN)


def strip_accents_any(text: Column) -> Column:
    """The same for any alphabet, by canonical decomposition."""

    def bare(text: str | None) -> str | None:
        return None if text is None else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).upper()

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(bare)

    return F.pandas_udf(run, "string")(text)


def fold(text: Column) -> Column:
    """Accents off, upper case, every run of other characters than letters and numbers one space, none at the ends."""
    return F.trim(F.regexp_replace(strip_accents_upper(text), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def matching_key(text: Column) -> Column:
    """fold without spaces; for comparing only."""
    return F.replace(fold(text), F.lit(" "), F.lit(""))


def edit_distance_within(a: Column, b: Column, limit: int) -> Column:
    """Levenshtein distance in characters, null beyond the limit."""
    found = F.levenshtein(a, b, limit)
    return F.when(found >= 0, found)


def collapse(text: Column) -> Column:
    """Unicode white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(folded: Column) -> Column:
    """Runs of digits and runs of other non-blank characters."""
    return F.regexp_extract_all(folded, F.lit(r"([0-9]+|[^0-9\s]+)"), F.lit(1))


def unmap_symbols(text: Column) -> Column:
    """Private-use characters U+F020 to U+F0FF, as symbol fonts have them, to the characters they stand for."""
    private = "".join(chr(0xF000 + c) for c in range(0x20, 0x100))
    return F.translate(text, private, "".join(chr(c) for c in range(0x20, 0x100)))


def unclosed_quote(text: Column) -> Column:
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return count("«") > count("»")


def opens_entry(line: Column) -> Column:
    """A capital letter and a full stop begin a new name."""
    return line.rlike(r"^\p{Lu}\.")


def is_bare_abbreviation(text: Column) -> Column:
    """Capitals and full stops only, one to five capitals."""
    bare = F.regexp_replace(text, r"\.+$", "")
    letters = F.length(F.regexp_replace(bare, r"\.", ""))
    return bare.rlike(r"^[\p{Lu}.]+$") & (letters <= 5)


def trails_off(text: Column) -> Column:
    return F.element_at(F.split(fold(text), " "), -1).isin(CONNECTORS)


def only_connectors(text: Column) -> Column:
    return F.forall(F.split(fold(text), " "), lambda w: w.isin(CONNECTORS))


def continues(before: Column, line: Column) -> Column:
    """Whether a line goes on with the name on the line before."""
    waiting = unclosed_quote(before) | is_bare_abbreviation(before) | trails_off(before)
    return F.when(opens_entry(line), False).when(line.startswith("«"), ~before.contains("»")).otherwise(waiting)


_TRAILING = r"(?iU)^(.*?)((?:\s+(?:έως|εως|ΕΩΣ|ΈΩΣ|μέχρι|μεχρι|ΜΕΧΡΙ|ΜΈΧΡΙ))?\s+[0-9]{1,2}[:.][0-9]{2})$"


def split_trailing_hours(name: Column) -> Column:
    """struct(name, notes): a closing time of day, with the word for `until` before it, moved to the notes."""
    clean = F.trim(name)
    hours = F.trim(F.regexp_extract(clean, _TRAILING, 2))
    return F.when(hours != "", F.struct(F.trim(F.regexp_extract(clean, _TRAILING, 1)).alias("name"), hours.alias("notes"))).otherwise(F.struct(clean.alias("name"), F.lit(None).cast("string").alias("notes")))


def html_escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def form_encode(text: Column) -> Column:
    """Percent-encoding that keeps unreserved characters and turns spaces into plus signs."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
