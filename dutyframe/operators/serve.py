"""The read queries: who is on call, entity search and lookup, issues, sources."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.functions.geo import bounding_box, distance_km, valid_point
from dutyframe.functions.text import matching_key
from dutyframe.operators.schemas import KINDS

MAX_ROWS, DEFAULT_ROWS = 500, 100
MIN_RADIUS_KM, MAX_RADIUS_KM, DEFAULT_RADIUS_KM = 0.1, 50.0, 3.0


def clamp_rows(limit: int) -> int:
    return min(max(limit, 1), MAX_ROWS)


def clamp_radius(km: float) -> float:
    return min(max(km, MIN_RADIUS_KM), MAX_RADIUS_KM)


def on_call(
    properties: DataFrame,
    entities: DataFrame,
    snapshots: DataFrame,
    day: datetime.date,
    kind: str | None = None,
    near: tuple[float, float] | None = None,
    radius_km: float = DEFAULT_RADIUS_KM,
    limit: int = DEFAULT_ROWS,
) -> DataFrame:
    """Entities on duty on a day by current snapshots, by name, or the nearest first.

    properties: entity_id, snapshot_id, on_date, starts_at, ends_at, payload, superseded;
    entities: id, kind, name, ...; snapshots: id, source_id, url. With `near`, rows outside the
    radius or without coordinates drop out; the box before the exact distance reaches the scan.
    All rows in the radius compete for the nearest places (no cut by name before the distance).
    """
    rows = properties.filter((F.col("on_date") == F.lit(day)) & ~F.col("superseded"))
    who = entities if kind is None else entities.filter(F.col("kind") == kind)
    if near is not None:
        south, north, west, east = bounding_box(*near, clamp_radius(radius_km))
        who = who.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
        who = who.withColumn("distance_km", distance_km(F.col("lat"), F.col("lon"), F.lit(near[0]), F.lit(near[1]))).filter(F.col("distance_km") <= clamp_radius(radius_km))
    else:
        who = who.withColumn("distance_km", F.lit(None).cast("double"))
    where = snapshots.select(F.col("id").alias("snapshot_id"), "source_id", F.col("url").alias("source_url"))
    who = who.withColumnRenamed("id", "entity_id")
    if "kind" in rows.columns:
        rows = rows.withColumnRenamed("kind", "property_kind")
    joined = rows.drop("superseded").join(who, "entity_id").join(where, "snapshot_id")
    first = ["distance_km"] if near is not None else []
    order = [F.col(c).asc_nulls_first() for c in [*first, "name", "starts_at", "ends_at", "entity_id", "snapshot_id", "payload"]]
    return joined.orderBy(*order).limit(clamp_rows(limit))


def with_attribution(rows: DataFrame) -> DataFrame:
    """rows (source_id) with the attribution that their source asks for; a row per known source is broadcast."""
    known = sources_table(rows.sparkSession).select(F.col("id").alias("source_id"), "attribution")
    return rows.join(F.broadcast(known), "source_id", "left")


def read_kind(text: str) -> str:
    """A kind of entity, as an argument names it."""
    if text not in KINDS:
        raise ValueError(f"no kind {text!r}; known: {', '.join(KINDS)}")
    return text


def counts_by(rows: DataFrame, by: str, wanted: Column, total: str = "entities", some: str = "wanted") -> DataFrame:
    """For each value of `by` the number of rows, and of those that are wanted."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias(total), F.count_if(wanted).alias(some))


def read_requests(asked: DataFrame) -> DataFrame:
    """Requests as a table (near `lat,lon`, date, kind, limit, radius, all text or null) with their arguments read.

    limit, radius_km: clamped, the defaults where there is none or no number; lat, lon, day, kind: null where there is none or it is refused; refused: the
    names of the arguments that can't be taken, in order. Other columns stay.
    """
    point = valid_point(*[F.trim(F.regexp_extract("near", r"^([^,]*),([^,]*)$", k)).try_cast("double") for k in (1, 2)])
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date", "yyyy-MM-dd"))
    kind = F.when(F.col("kind").isin(KINDS), F.col("kind"))
    rows = F.coalesce(F.col("limit").try_cast("int"), F.lit(DEFAULT_ROWS))
    km = F.coalesce(F.col("radius").try_cast("double"), F.lit(DEFAULT_RADIUS_KM))
    bad = [F.when(F.col(name).isNotNull() & read.isNull(), F.lit(name)) for name, read in (("near", point), ("date", day), ("kind", kind))]
    others = [c for c in asked.columns if c not in ("near", "date", "kind", "limit", "radius")]
    return asked.select(
        *others, F.least(F.greatest(rows, F.lit(1)), F.lit(MAX_ROWS)).alias("limit"), F.least(F.greatest(km, F.lit(MIN_RADIUS_KM)), F.lit(MAX_RADIUS_KM)).alias("radius_km"),
        point["lat"].alias("lat"), point["lon"].alias("lon"), day.alias("day"), kind.alias("kind"), F.array_compact(F.array(*bad)).alias("refused"),
    )


def response(rows: DataFrame, column: str = "payload") -> DataFrame:
    """One row: the number of rows and all of them as nested JSON, as the reading queries answer (they stop at MAX_ROWS)."""
    lines = nested_payload(rows.limit(MAX_ROWS), column)
    return lines.agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("json")).alias("results"))


def search_entities(entities: DataFrame, kind: str | None = None, search: str | None = None, limit: int = DEFAULT_ROWS) -> DataFrame:
    """Entities by name; `search` is folded like names are and matched anywhere in name_folded."""
    if kind is not None:
        entities = entities.filter(F.col("kind") == kind)
    if search is not None:
        entities = entities.filter(F.col("name_folded").contains(matching_key(F.lit(search))))
    return entities.orderBy("name", "id").limit(clamp_rows(limit))


def entity(entities: DataFrame, key: int) -> DataFrame:
    return entities.filter(F.col("id") == key)


def issue_report(issues: DataFrame, source: str | None = None, limit: int = DEFAULT_ROWS) -> DataFrame:
    """Issues, errors before warnings before the rest, newest first."""
    if source is not None:
        issues = issues.filter(F.col("source_id") == source)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.orderBy(rank, F.col("created_at").desc(), *[F.col(c).asc_nulls_first() for c in ("source_id", "code", "detail")]).limit(limit)


def nested_payload(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Rows as JSON lines, the payload as nested JSON where it parses, as text where it doesn't."""
    others = [c for c in rows.columns if c != column]
    nested = F.coalesce(F.try_parse_json(column), F.parse_json(F.to_json(F.struct(F.col(column).alias("text"))))).alias(column)
    return rows.select(F.to_json(F.struct(*others, nested)).alias("json"))


def sources_table(spark: SparkSession) -> DataFrame:
    from dutyframe.sources import registry

    return spark.createDataFrame([(s.id, s.group, s.attribution) for s in registry.all_sources()], "id string, group string, attribution string")
