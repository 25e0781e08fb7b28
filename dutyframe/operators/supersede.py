"""Supersession as a view: history stays, and only the latest revision of a source's day is served."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per value of keys: the one with the largest values of newest (nulls are the smallest).

    It is found by aggregation, before the shuffle as far as possible.
    """
    others = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*newest)).alias("__top"))
    return top.select(*[F.col(c) if c in keys else F.col("__top")[c].alias(c) for c in df.columns])


def current_snapshots(snapshots: DataFrame, source: str = "source_id", day: str = "published_date", revision: str = "revision", key: str = "id") -> DataFrame:
    """The ids that are served: the highest revision, then id, of each source and day; undated snapshots all.

    Only an id per (source, day) is kept, by one aggregation with map-side combine, so a day with
    very many revisions doesn't come together in one task.
    """
    dated = snapshots.filter(F.col(day).isNotNull()).groupBy(source, day).agg(F.max(F.struct(F.col(revision), F.col(key))).alias("top"))
    return dated.select(F.col("top")[key].alias(key)).unionByName(snapshots.filter(F.col(day).isNull()).select(key))


def flag_superseded(properties: DataFrame, current: DataFrame, snapshot: str = "snapshot_id", key: str = "id") -> DataFrame:
    """properties with a column superseded."""
    served = current.select(F.col(key).alias("__served"))
    return properties.join(served, properties[snapshot] == served["__served"], "left").withColumn("superseded", F.col("__served").isNull()).drop("__served")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per value of keys: the first in order; later ones are ignored."""
    columns = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("__first"))
    return first.select(*keys, *[F.col("__first")[c].alias(c) for c in columns if c not in keys])
