"""Tables out of positioned words, as running values in order.

Glyphs: page, text, x, y, advance, font_size. Words: page, text, x, y, width, font_size. A page is
the unit of work: scans are partitioned by `page` columns, and a page of any length may be spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyframe.operators.scan import Segments, anchored_groups, floor_join, islands, islands_in
from dutyframe.operators.tables import written

# Fixed values of the layout: tolerances in points or as shares of the font size.
LINE_SHARE, LINE_LEAST = 0.4, 1.5
WORD_GAP_SHARE = 0.28
CELL_GAP_FONTS, CELL_GAP_LEAST = 2.0, 20.0
HEADER_TOLERANCE = 6.0
ROW_GAP_FONTS = 1.5


def end_x(x: Column, width: Column) -> Column:
    return x + width


def centre_x(x: Column, width: Column) -> Column:
    return x + width / 2


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def words_of_glyphs(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, word, text, x, y, width, font_size from glyphs.

    Glyphs follow one another in a line while y differs little from the glyph before; a word ends
    at a blank glyph or a wide gap.
    """
    near = lambda before: F.abs(F.col("y") - before("y")) > F.greatest(F.col("font_size") * LINE_SHARE, F.lit(LINE_LEAST))
    pages = islands_in(Segments(glyphs, keys, ["y", "x", "text"], dealt=True), near, "line")
    by = Window.partitionBy(*keys, "line").orderBy("x")
    # what can be worked out again isn't sorted
    shown = pages.rows().withColumn("__after", F.lag("text").over(by)).filter(F.trim("text") != "")
    flagged = shown.withColumns({"__after_blank": F.coalesce(F.trim("__after") == "", F.lit(False)), "__end": F.col("x") + F.col("advance")}).drop("__after")
    wide = lambda before: F.col("__after_blank") | (F.col("x") - before("__end") > F.col("font_size") * WORD_GAP_SHARE)
    words = islands_in(Segments(flagged, [*keys, "line"], ["x"], within=pages), wide, "word").rows()
    return words.groupBy(*keys, "line", "word").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda g: g["text"]), "").alias("text"),
        F.min("x").alias("x"),
        F.min_by("y", "x").alias("y"),
        (F.max("__end") - F.min("x")).alias("width"),
        F.max("font_size").alias("font_size"),
    )


def line_texts(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, y, text: the words of each line from left to right."""
    return words.groupBy(*keys, "line").agg(F.min("y").alias("y"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("text"))


def header_cells(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cell, label, start, end from the words of header rows."""
    far = lambda before: F.col("x") - before("__end") > F.greatest(F.col("font_size") * CELL_GAP_FONTS, F.lit(CELL_GAP_LEAST))
    cells = islands(words.withColumn("__end", end_x(F.col("x"), F.col("width"))), keys, ["x"], far, "cell")
    return cells.groupBy(*keys, "cell").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("label"),
        F.min("x").alias("start"),
        F.max("__end").alias("end"),
    )


def column_bounds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells with low and high: borders halfway to the neighbours, without end at both sides."""
    by = Window.partitionBy(*keys).orderBy("start", "cell")
    low = midpoint(F.lag("end").over(by), F.col("start"))
    high = midpoint(F.col("end"), F.lead("start").over(by))
    infinite = F.lit("Infinity").cast("double")
    return cells.withColumns({"low": F.coalesce(low, -infinite), "high": F.coalesce(high, infinite)})


def assign_interval(points: DataFrame, bounds: DataFrame, keys: list[str], at: str) -> DataFrame:
    """points joined with the bounds row whose low <= at < high, within equal keys."""
    inside = (F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))
    on = inside
    for k in keys:
        on = on & (points[k] == bounds[k])
    joined = points.join(bounds, on)
    for k in keys:
        joined = joined.drop(bounds[k])
    return joined


def reconstruct(words: DataFrame, keys: list[str], is_header) -> DataFrame:
    """keys, column, label, row, row_label, line, text: the table of each page that has one.

    is_header takes the text of a line (a column of line_texts) and gives a boolean column. A page
    without a header, with one column or without rows gives nothing. The left edge of a word
    selects its column. Column 0 holds the row labels; a row begins with a word there whose
    distance from the row's first word is more than ROW_GAP_FONTS font sizes.
    """
    heads = line_texts(words, keys).filter(is_header(F.col("text"))).groupBy(*keys).agg(F.min("y").alias("head_y"))
    placed = words.join(heads, keys)
    header = placed.filter(F.abs(F.col("y") - F.col("head_y")) <= HEADER_TOLERANCE)
    cells = column_bounds(header_cells(header, keys), keys)
    many = Window.partitionBy(*keys)
    cells = cells.withColumn("__n", F.count(F.lit(1)).over(many)).filter("__n > 1").select(*keys, (F.col("cell") - 1).alias("column"), "label", "low", "high")
    body = written(assign_interval(placed.filter(F.col("y") > F.col("head_y") + HEADER_TOLERANCE), cells, keys, "x"), "table-words")
    labels = _within_first(body.filter("column = 0"), keys, "row", lambda font: font * ROW_GAP_FONTS)
    rows = labels.groupBy(*keys, "row").agg((F.min("y") - HEADER_TOLERANCE).alias("top"), _in_order("y", "x").alias("row_label"))
    in_rows = floor_join(body.filter("column > 0"), rows.withColumn("mark", F.struct("row", "row_label")), keys, "y", "top", "mark").filter("mark is not null")
    cell = [*keys, "column", "label", "row", "row_label"]
    placed = in_rows.select(*keys, "column", "label", "mark.row", "mark.row_label", "y", "x", "text", "font_size")
    lines = _within_first(written(placed, "cell-words"), cell, "line", lambda font: F.greatest(font * LINE_SHARE, F.lit(LINE_LEAST)))
    return lines.groupBy(*cell, "line").agg(_in_order("x").alias("text"))


def _in_order(*order: str) -> Column:
    """The texts of a group as one, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda w: w["text"]), " ")


def _within_first(words: DataFrame, keys: list[str], name: str, tolerance) -> DataFrame:
    """words with a running number of groups downwards: a group holds what is within tolerance(font size of the keys' first word) of its first word."""
    first = words.groupBy(*keys).agg(F.min(F.struct("y", "x", "text", "font_size"))["font_size"].alias("__font"))
    sized = written(words.join(first, keys), "sized-words")
    return anchored_groups(sized, keys, "y", F.col("y") + tolerance(F.col("__font")), name).drop("__font")


def expand_width_runs(runs: DataFrame, first: str = "first", last: str = "last", most: int = 4096) -> DataFrame:
    """A row per glyph code of runs `first last width`; runs longer than `most` codes are left out, as fonts have none."""
    usable = runs.filter((F.col(last) >= F.col(first)) & (F.col(last) - F.col(first) < most))
    return usable.withColumn("code", F.explode(F.sequence(first, last))).drop(first, last)
