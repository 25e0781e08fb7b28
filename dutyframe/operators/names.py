"""Entries out of the lines of a table column: wrapped names joined, remarks and hours moved to notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dutyframe.functions.text import continues, fold, only_connectors, split_trailing_hours, unclosed_quote

_ENTRY = "struct<line:int,name:string,notes:string>"


def split_entries(lines: Column) -> Column:
    """array<struct<line, name, notes>> from an array of lines, line being where an entry begins (from 0).

    A line in brackets is a note of the entry before it, and an entry of its own without one. A line
    that goes on with the name before it is joined to it. Names of connecting words only are no entries.
    """
    trimmed = F.transform(lines, lambda x, k: F.struct(k.cast("int").alias("k"), F.trim(x).alias("text")))
    full = F.filter(trimmed, lambda x: x["text"] != "")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        with_note = F.struct(last["line"].alias("line"), last["name"].alias("name"), F.concat_ws(" ", last["notes"], x["text"]).alias("notes"))
        longer = F.struct(last["line"].alias("line"), F.concat_ws(" ", last["name"], x["text"]).alias("name"), last["notes"].alias("notes"))
        fresh = F.struct(x["k"].alias("line"), x["text"].alias("name"), F.lit(None).cast("string").alias("notes"))
        return (
            F.when(last.isNotNull() & x["text"].startswith("("), F.concat(rest, F.array(with_note)))
            .when(last.isNotNull() & continues(last["name"], x["text"]), F.concat(rest, F.array(longer)))
            .otherwise(F.concat(done, F.array(fresh)))
        )

    joined = F.aggregate(full, F.array().cast(f"array<{_ENTRY}>"), step)

    def hours(e: Column) -> Column:
        cut = split_trailing_hours(e["name"])
        notes = F.nullif(F.concat_ws(" ", e["notes"], cut["notes"]), F.lit(""))
        return F.struct(e["line"].alias("line"), cut["name"].alias("name"), notes.alias("notes"))

    return F.filter(F.transform(joined, hours), lambda e: ~only_connectors(e["name"]))


def line_counts(text: Column) -> Column:
    """struct(lines, remarks): the lines of a text, and those of them in brackets."""
    lines = F.split(text, "\n")
    return F.struct(F.size(lines).alias("lines"), F.size(F.filter(lines, lambda x: x.startswith("("))).alias("remarks"))


def is_suspicious(name: Column) -> Column:
    """A quote left open, or a closing one in front: a name the layout has split."""
    return unclosed_quote(name) | name.startswith("»")


def is_table_header(text: Column) -> Column:
    """The row-label cell's word at the start, or two clock times at least."""
    clocks = F.size(F.filter(F.split(text, " "), lambda w: w.rlike("^[0-9]*:")))
    return fold(text).startswith("ΚΛΙΝΙΚΕΣ") | (clocks >= 2)
