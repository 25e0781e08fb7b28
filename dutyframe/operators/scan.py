"""Running values in order within keys, for keys of any size.

A window runs over all rows of a key in one task. Here the rows of a key with more than ROWS_IN_A_TASK rows are cut
by ranges of the order into segments: a window runs within each, one row for each segment is put
together over the key's segments, and what comes before a segment is added to its rows. All other keys are one segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyframe.operators.tables import written

#: Rows of one key that one task may hold; a key with more is cut.
ROWS_IN_A_TASK = 1_000_000
#: Segments that are cut at most, as long as each has no more than ROWS_IN_A_TASK rows: a smaller `most` says which keys are cut, not how many tasks and carried rows there are.
SEGMENTS = 128
SEGMENT = "__segment"

#: How two values in order make one: running sum, least, greatest, or last value that isn't null.
_JOIN = {
    "sum": lambda before, own: F.coalesce(before + own, own, before),
    "min": F.least,
    "max": F.greatest,
    "last": lambda before, own: F.coalesce(own, before),
}
_OVER = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def _ranges(rows: int, most: int) -> int:
    """Into how many ranges so many rows are cut."""
    return min(-(-rows // most) + 1, max(SEGMENTS, -(-rows // ROWS_IN_A_TASK) + 1))


class Segments:
    """df cut for scans in one order; the scans of one object share its cuts, its shuffle and its sort.

    Order: ascending, nulls first, so descending orders are given as negated columns. Rows that tie in all
    of it are in no certain order, so give columns that leave only equal rows tied. keys may be empty: all rows are one key.
    With `dealt` the rows of uncut keys go to as many tasks as leave each half of ROWS_IN_A_TASK, or one key: Spark joins tasks by
    their bytes after compression, which are a small part of what narrow, similar rows take to sort. within: segments
    of the same rows by fewer keys; a key can be large only where one of those was cut.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], most: int | None = None, dealt: bool = False, within: Segments | None = None):
        self.keys, self.order = keys, order
        most = ROWS_IN_A_TASK if most is None else most
        counted = df if within is None else within.df.filter(F.col(SEGMENT) > 0)  # the rows of cut keys
        sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        hot = sizes.filter(F.col("__n") > most)
        everything, rows = (None, None) if within is not None and not within.cut else sizes.agg(F.sum("__n"), F.sum(F.when(F.col("__n") > most, F.col("__n")))).first()
        self.cut = rows is not None
        if not self.cut:
            if dealt and keys and (everything or 0) > ROWS_IN_A_TASK:
                df = df.repartition(-(-2 * everything // ROWS_IN_A_TASK), *keys)
            self.df = df.withColumn(SEGMENT, F.lit(0))
            return
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}"))
        # a key of more than `most` rows each
        few = F.broadcast(written(hot.select(*keys, F.lit(True).alias("__is_hot")), "hot-keys")).alias("h")
        met = df.alias("r").join(few, same, "left") if keys else df.alias("r").withColumn("__is_hot", F.lit(True))
        columns = [F.col(f"r.{c}") for c in df.columns]
        rest = met.filter("__is_hot is null").select(*columns).withColumn(SEGMENT, F.lit(0))
        # a stated number of ranges, which are not put together again however few bytes they have
        ranged = met.filter("__is_hot").select(*columns).repartitionByRange(_ranges(rows, most), *keys, *order).withColumn(SEGMENT, F.spark_partition_id() + 1)
        self.df = rest.unionByName(written(ranged, "segments"))

    def _window(self):
        return Window.partitionBy(*self.keys, SEGMENT).orderBy(*self.order)

    def scan(self, name: str, value: Column, how: str, before: bool = False) -> Segments:
        """With column name: the sum, min, max or last non-null value up to each row, or, with `before`, up to the row before it; null if there is none."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        rows = self.df.withColumn("__value", value)
        local = rows.withColumn(name, _OVER[how](F.col("__value")).over(frame)).drop("__value")
        out = Segments.__new__(Segments)
        out.keys, out.order, out.cut = self.keys, self.order, self.cut
        if not self.cut:
            out.df = local
            return out
        whole = F.max_by(F.when(F.col("__value").isNotNull(), F.col("__value")), F.when(F.col("__value").isNotNull(), F.struct(*self.order))) if how == "last" else _OVER[how](F.col("__value"))
        totals = rows.filter(F.col(SEGMENT) > 0).groupBy(*self.keys, SEGMENT).agg(whole.alias("__total"))
        earlier = Window.partitionBy(*self.keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(*[F.col(k).alias(f"__k_{k}") for k in self.keys], F.col(SEGMENT).alias("__s"), _OVER[how](F.col("__total")).over(earlier).alias("__carry"))
        same = F.col(SEGMENT) == F.col("__s")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        joined = local.join(F.broadcast(carry), same, "left")  # a row for each segment of a cut key
        out.df = joined.withColumn(name, _JOIN[how](F.col("__carry"), F.col(name))).select(*local.columns)
        return out

    def with_columns(self, new: dict[str, Column]) -> Segments:
        out = Segments.__new__(Segments)
        out.keys, out.order, out.cut, out.df = self.keys, self.order, self.cut, self.df.withColumns(new)
        return out

    def rows(self) -> DataFrame:
        return self.df.drop(SEGMENT)


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Callable[[Callable[[str], Column]], Column], name: str, most: int | None = None) -> DataFrame:
    """df with a running number of islands from 1: breaks says, from the previous row's columns, where one ends.

    breaks takes a function that gives the previous row's value of a column. A key's first row begins one, as does a row where breaks is null.
    """
    return islands_in(Segments(df, keys, order, most), breaks, name).rows()


def islands_in(rows: Segments, breaks: Callable[[Callable[[str], Column]], Column], name: str) -> Segments:
    """The same over segments, whose cuts it keeps."""
    used: list[str] = []
    breaks(lambda c: (used.append(c), F.col(c))[1])
    used = list(dict.fromkeys(used))
    if rows.cut:
        previous = F.struct(*[F.col(c) for c in used]) if used else F.struct(F.lit(1))
        told = rows.scan("__before", previous, "last", before=True)
        before, begins = (lambda c: F.col("__before")[c]), F.col("__before").isNull()
    else:  # a window tells the row before; no copy of its columns is shuffled and sorted
        by = rows._window()
        told = rows.with_columns({**{f"__before_{c}": F.lag(c).over(by) for c in used}, "__before": F.row_number().over(by)})
        before, begins = (lambda c: F.col(f"__before_{c}")), F.col("__before") == 1
    new = F.coalesce(breaks(before), F.lit(True)) | begins
    told = told.with_columns({"__new": new.cast("long")}).scan(name, F.col("__new"), "sum")
    told.df = told.df.withColumn(name, F.col(name).cast("int")).drop("__before", "__new", *[f"__before_{c}" for c in used])
    return told


def floor_join(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, value: str, most: int | None = None) -> DataFrame:
    """points with the value of the last mark at or before each, within equal keys; null before the first.

    Both sides are one ordered stream; no pair of a point and a mark is made. A mark whose value is null is none.
    Of marks at one place the greatest value counts.
    """
    left = points.withColumns({"__at": F.col(at), "__kind": F.lit(1), "__value": F.lit(None).cast(marks.schema[value].dataType)})
    right = marks.select(*[F.col(k) for k in keys], F.col(mark).alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__value"))
    both = left.unionByName(right, allowMissingColumns=True)
    found = Segments(both, keys, ["__at", "__kind", "__value"], most).scan("__last", F.col("__value"), "last")
    out = found.rows().filter("__kind = 1").drop(value) if value in points.columns else found.rows().filter("__kind = 1")
    return out.withColumn(value, F.col("__last")).drop("__at", "__kind", "__value", "__last")


def anchored_groups(df: DataFrame, keys: list[str], at: str, reach: Column, name: str, most: int | None = None) -> DataFrame:
    """df with a running number of groups from 1: a group begins with the first row beyond the reach of the row that began the one before.

    at: where a row is, a number; reach: how far a group goes that begins with this row (its own place at least). The comparison is
    with the group's first row, not with the one before, so a window function can't tell groups apart. Of rows at one
    place the shortest reach counts. A null place is in no group (null).

    The rows of a key are walked once, in order. A key of more than `most` rows is not walked by one task: each place has one place where
    the next group would begin, found as the first one beyond its reach in one ordered stream, and the groups that do begin are those met
    from the key's first place. Jumps of 2**k groups double in each round, and so do the groups found.
    """
    most = ROWS_IN_A_TASK if most is None else most
    ready = df.withColumns({"__place": F.col(at), "__reach": F.greatest(F.coalesce(reach, F.col(at)), F.col(at))})
    hot = ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    if hot.isEmpty():
        return _walked(ready, keys, name)
    if not keys:
        return _doubled(ready, keys, name, most)
    few = written(hot.select(*[F.col(k).alias(f"__k_{k}") for k in keys]), "hot-keys")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    few = F.broadcast(few)
    return _walked(ready.join(few, same, "left_anti"), keys, name).unionByName(_doubled(ready.join(few, same, "left_semi"), keys, name, most))


def _walked(ready: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One pass over each key's rows in order."""
    columns = ready.columns
    shape = ready.drop("__place", "__reach").withColumn(name, F.lit(None).cast("int")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, limit, group = None, None, 0
        for batch in batches:
            of = {c: batch.column(columns.index(c)).to_pylist() for c in ("__place", "__reach", *keys)}
            out = []
            for place, far, *key in zip(of["__place"], of["__reach"], *(of[k] for k in keys), strict=True):
                if key != now:
                    now, limit, group = key, None, 0
                if place is None:
                    out.append(None)
                    continue
                if limit is None or place > limit:
                    limit, group = far, group + 1
                out.append(group)
            kept = [n for n, c in enumerate(columns) if c not in ("__place", "__reach")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.int32())], [*(columns[n] for n in kept), name])

    dealt = ready.repartition(*keys) if keys else ready.coalesce(1)
    return dealt.sortWithinPartitions(*keys, "__place", "__reach").mapInArrow(run, shape)


def _doubled(ready: DataFrame, keys: list[str], name: str, most: int) -> DataFrame:
    """The same for keys of any size."""
    there = ready.filter("__place is not null")
    spots = written(there.groupBy(*keys, F.col("__place").alias("__at")).agg(F.min("__reach").alias("__reach")), "spots")
    # backwards, so that the last mark before a reach is the first place beyond it
    back = lambda c: -F.col(c)
    none = F.lit(None).cast(spots.schema["__at"].dataType)
    probes = spots.select(*keys, F.col("__at").alias("__own"), back("__reach").alias("__place"), F.lit(0).alias("__kind"), none.alias("__mark"))
    marks = spots.select(*keys, none.alias("__own"), back("__at").alias("__place"), F.lit(1).alias("__kind"), F.col("__at").alias("__mark"))
    stream = Segments(probes.unionByName(marks), keys, ["__place", "__kind", "__own"], most).scan("__next", F.col("__mark"), "last")
    jump = written(stream.rows().filter("__kind = 0 and __next is not null").select(*keys, F.col("__own").alias("__at"), "__next"), "jumps")
    begun, step = written(spots.groupBy(*keys).agg(F.min("__at").alias("__at")).withColumn(name, F.lit(1).cast("long")), "begun"), 1
    while True:
        onward = _hop(begun, jump, keys).select(*keys, F.col("__next").alias("__at"), (F.col(name) + step).alias(name))
        more = written(onward, "begun")
        if more.isEmpty():
            break
        begun, step = begun.unionByName(more), step * 2
        twice = _hop(jump.withColumnRenamed("__next", "__mid"), jump.withColumnRenamed("__at", "__mid"), keys, "__mid")
        jump = written(twice.select(*keys, "__at", "__next"), "jumps")
    rows = ready.drop("__reach").withColumnRenamed("__place", "__where")
    found = floor_join(rows.filter("__where is not null"), begun, keys, "__where", "__at", name, most)
    return found.unionByName(rows.filter("__where is null"), allowMissingColumns=True).withColumn(name, F.col(name).cast("int")).drop("__where")


def _hop(left: DataFrame, jump: DataFrame, keys: list[str], on: str = "__at") -> DataFrame:
    """left with the jump from its place; a key and a place are one row of jump at most. Null keys are equal."""
    renamed = jump.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(on).alias("__from"), "__next")
    same = F.col(on) == F.col("__from")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(renamed, same).drop("__from", *[f"__k_{k}" for k in keys])
