"""Duty pharmacies: a date picker, and for each date a page of cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutyframe.functions.dates import in_window
from dutyframe.functions.geo import point_of_map_link
from dutyframe.functions.text import collapse, matching_key
from dutyframe.functions.times import on_day, parse_ranges
from dutyframe.operators.tables import written
from dutyframe.sources.base import Source
from dutyframe.sources.html import FAILED, MOST_BYTES, elements, inside


class Pharmacies(Source):
    id = "fsa-attica-pharmacies"
    group = "pharmacies"
    attribution = "Pharmacists' Association of Attica"
    most_bytes: int | None = MOST_BYTES

    def discover(self, listings: DataFrame, first: str, last: str) -> DataFrame:
        """A form reference for each date of the picker in the window."""
        found = written(elements(listings, "page_id", "html").filter("tag in ('select', 'option')"), "elements")
        pickers = found.filter((F.col("tag") == "select") & (F.col("attrs")["id"] == "Date"))
        options = inside(found.filter("tag = 'option'"), pickers, "page_id")
        dates = options.select(F.try_to_date(F.trim(F.col("attrs")["value"]), "yyyy-MM-dd").alias("published_date")).filter("published_date is not null")
        chosen = dates.filter(in_window(F.col("published_date"), F.lit(first).cast("date"), F.lit(last).cast("date")))
        day = F.date_format("published_date", "yyyy-MM-dd")
        return chosen.distinct().select(F.lit(self.id).alias("source_id"), F.concat(F.lit("Date="), day).alias("form"), "published_date", F.lit(0).alias("revision"), day.alias("label"), F.lit(True).alias("volatile"))

    def parse(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """documents: snapshot_id, content, published_date. One record per readable window of a card, at least one per card."""
        found = written(elements(documents, "snapshot_id", "content", self.most_bytes), "elements")  # read once for all that follows
        cards = found.filter((F.col("tag") == "div") & F.array_contains("classes", "card"))
        local = F.nullif(F.trim(F.col("attrs")["id"]), F.lit(""))
        below = inside(found, cards, "snapshot_id").withColumnRenamed("owner", "card")
        parts = below.select("snapshot_id", "card", "n", "tag", "classes", "attrs", "parents", collapse(F.col("text")).alias("text"))
        of_class = lambda name: parts.filter(F.array_contains("classes", name)).select("snapshot_id", "card", F.col("n").alias("part"))

        def within(name: str, tag: str) -> DataFrame:
            up = parts.filter(F.col("tag") == tag).withColumn("part", F.explode("parents"))
            return up.join(of_class(name), ["snapshot_id", "card", "part"]).filter("text != ''")

        first = lambda df, c, name: df.groupBy("snapshot_id", "card").agg(F.min_by(c, "n").alias(name))
        address = first(within("card-title", "h6"), "text", "address")
        town = first(parts.filter(F.array_contains("classes", "card-subtitle") & (F.col("text") != "")), "text", "municipality")
        phone = first(within("card-text", "h6"), "text", "phone")
        details = within("card-text", "span").groupBy("snapshot_id", "card").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda d: d["text"]).alias("details"))
        link = first(parts.filter((F.col("tag") == "a") & F.col("attrs")["href"].contains("query=")), F.col("attrs")["href"], "link")
        rows = cards.select("snapshot_id", F.col("n").alias("card"), local.alias("local_id"))
        for more in (address, town, phone, details, link):
            rows = rows.join(more, ["snapshot_id", "card"], "left")
        rows = rows.join(documents.select("snapshot_id", F.col("published_date").alias("on_date")), "snapshot_id")
        one, two = F.try_element_at("details", F.lit(1)), F.try_element_at("details", F.lit(2))
        hours = lambda c: F.size(parse_ranges(c)) > 0
        swapped = F.when(two.isNull(), hours(one)).otherwise(hours(one) & ~hours(two))
        rows = rows.withColumns({"pharmacist": F.when(swapped, two).otherwise(one), "hours_text": F.when(swapped, one).otherwise(two), "point": point_of_map_link(F.col("link"))})
        windows = F.transform(parse_ranges(F.col("hours_text")), lambda w: on_day(w, F.col("on_date")))
        rows = rows.withColumn("windows", windows)
        good = rows.filter("local_id is not null").withColumn("name", F.coalesce("pharmacist", "address", F.concat(F.lit("Φαρμακείο "), "local_id")))
        payload = F.to_json(F.struct(F.lit("pharmacy_on_call").alias("type"), "pharmacist", "hours_text"))
        records = good.withColumn("w", F.explode_outer("windows")).select(
            "snapshot_id", F.lit(self.id).alias("source_id"), "local_id", F.lit("pharmacy").alias("kind"), "name", matching_key(F.col("name")).alias("name_folded"), F.lit("source_key").alias("identity"),
            "address", "municipality", "point.lat", "point.lon", "phone", "on_date", "w.starts_at", "w.ends_at", payload.alias("payload"), F.col("card").cast("long").alias("seq"),
        )
        no_id = self.issues(rows.filter("local_id is null"), "warning", "card_without_id", F.lit("duty card has no id"))
        no_place = self.issues(good.filter("point is null"), "warning", "missing_location", F.concat(F.lit("no usable coordinates: "), "local_id"))
        no_hours = self.issues(good.filter(F.size("windows") == 0), "warning", "unreadable_hours", F.concat_ws(": ", "local_id", "hours_text"))
        broken = found.filter(F.col("tag") == FAILED)
        failed = self.issues(broken, "error", "document_failed", F.col("text"))
        empty = self.issues(documents.join(broken.select("snapshot_id"), "snapshot_id", "left_anti").join(records.select("snapshot_id").distinct(), "snapshot_id", "left_anti"), "warning", "empty_document", F.lit("no records"))
        return records, no_id.unionByName(no_place).unionByName(no_hours).unionByName(empty).unionByName(failed)
