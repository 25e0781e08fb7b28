"""Duty hospitals: a list of files with dates in their names, and rotas as tables of positioned words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyframe.functions.dates import in_window, parse_date, parse_revision
from dutyframe.functions.text import fold, matching_key
from dutyframe.functions.times import on_day, parse_range
from dutyframe.operators import layout, names
from dutyframe.sources.base import Source
from dutyframe.sources.html import elements

LISTING = "https://www.moh.gov.gr/articles/citizen/efhmeries-nosokomeiwn/68-efhmeries-nosokomeiwn-attikhs"


def filename(title):
    """`Download: name (size)` to the name; null if nothing is left."""
    bare = F.trim(F.regexp_replace(F.trim(title), "^Download:", ""))
    return F.nullif(F.trim(F.regexp_replace(bare, r"\([^(]*$", "")), F.lit(""))


def borrowed_dates(files: DataFrame, keys: list[str], order: str) -> DataFrame:
    """files (date, is_pdf) with date filled from the file before, else after, where that is no PDF."""
    by = Window.partitionBy(*keys).orderBy(order)
    near = F.coalesce(*[F.when(~f("is_pdf").over(by), f("date").over(by)) for f in (F.lag, F.lead)])
    return files.withColumn("date", F.coalesce("date", near))


class Hospitals(Source):
    id = "moh-attica-hospitals"
    group = "hospitals"
    attribution = "Ministry of Health"

    def discover(self, listings: DataFrame, first: str, last: str) -> DataFrame:
        return self.published(listings).filter(in_window(F.col("published_date"), F.lit(first).cast("date"), F.lit(last).cast("date")))

    def published(self, listings: DataFrame) -> DataFrame:
        """url, published_date, revision and label of each PDF of a listing that can be dated.

        A long listing comes in parts (column `part`, which may be absent): pages of their own, whose files follow those of the part before.
        """
        if "part" not in listings.columns:
            listings = listings.withColumn("part", F.lit(0))
        listings = listings.select(F.struct("page_id", "part").alias("page"), "html")
        links = elements(listings, "page", "html").select("page.page_id", F.struct("page.part", "n").alias("n"), "tag", "attrs")
        links = links.filter((F.col("tag") == "a") & F.col("attrs")["href"].contains("fdl="))
        files = links.select("page_id", "n", F.col("attrs")["href"].alias("href"), filename(F.col("attrs")["title"]).alias("label")).filter("label is not null")
        files = files.withColumns({"date": parse_date(F.col("label")), "is_pdf": F.lower("label").endswith(".pdf")})
        dated = borrowed_dates(files, ["page_id"], "n").filter("is_pdf and date is not null")
        url = F.when(F.col("href").startswith("?"), F.concat(F.lit(LISTING), "href")).otherwise(F.col("href"))
        return dated.select(F.lit(self.id).alias("source_id"), url.alias("url"), F.col("date").alias("published_date"), parse_revision(F.col("label")).alias("revision"), "label", F.col("n")["n"].alias("n"))

    def parse(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """documents: snapshot_id, published_date, page, text, x, y, width, font_size, line: the words of rotas."""
        keys = ["snapshot_id", "page"]
        days = documents.groupBy("snapshot_id").agg(F.max("published_date").alias("on_date"))
        table = layout.reconstruct(documents.drop("published_date"), keys, names.is_table_header)
        order = F.array_sort(F.collect_list(F.struct("row", "line", "text", "row_label")))
        columns = table.groupBy(*keys, "column", "label").agg(order.alias("lines")).join(days, "snapshot_id")
        columns = columns.withColumn("entries", names.split_entries(F.transform("lines", lambda x: x["text"]))).filter(F.size("entries") > 0)
        columns = columns.withColumn("range", parse_range(F.col("label"))).withColumn("at", on_day(F.col("range"), F.col("on_date")))
        remarks = columns.filter("range is null")
        entries = columns.filter("range is not null").withColumn("e", F.explode("entries"))
        entries = entries.withColumn("clinic", F.trim(F.get(F.col("lines"), F.col("e.line"))["row_label"]))
        payload = F.to_json(F.struct(F.lit("hospital_on_call").alias("type"), "clinic", F.col("label").alias("shift"), F.col("e.notes").alias("notes")))
        none = F.lit(None).cast("string")
        common = lambda kind, name, town, body, seq: [
            "snapshot_id", F.lit(self.id).alias("source_id"), matching_key(name).alias("local_id"), F.lit(kind).alias("kind"), name.alias("name"), matching_key(name).alias("name_folded"), F.lit("name").alias("identity"),
            none.alias("address"), town.alias("municipality"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), none.alias("phone"), "on_date", "at.starts_at", "at.ends_at", body.alias("payload"), seq.cast("long").alias("seq"),
        ]
        hospitals = entries.select(*common("hospital", F.col("e.name"), F.lit("Αττική"), payload, F.col("page") * 1_000_000 + F.col("column") * 10_000 + F.col("e.line")))
        lines = layout.line_texts(documents, keys).filter(fold(F.col("text")).startswith("Κ Υ ")).join(days, "snapshot_id")
        lines = lines.withColumns({"name": F.trim(F.regexp_extract("text", "^([^:]*):", 1)), "hours": F.trim(F.regexp_extract("text", "^[^:]*:(.*)$", 1))}).filter("name != ''")
        lines = lines.withColumn("at", on_day(parse_range(F.col("hours")), F.col("on_date")))
        centres = lines.select(*common("health_centre", F.col("name"), none, F.to_json(F.struct(F.lit("health_centre_on_call").alias("type"))), F.col("page") * 1_000_000 + F.col("line")))
        records = hospitals.unionByName(centres)
        found = [
            self.issues(remarks, "info", "non_shift_column", F.col("label")),
            self.issues(entries.filter(names.is_suspicious(F.col("e.name"))), "warning", "suspicious_name", F.col("e.name")),
            self.issues(lines.filter("at is null"), "warning", "unreadable_hours", F.concat_ws(": ", "name", "hours")),
        ]
        many = documents.groupBy(*keys).agg(F.count_distinct("line").alias("n")).filter("n > 2")
        found.append(self.issues(many.join(table.select(*keys).distinct(), keys, "left_anti"), "info", "no_table_on_page", F.col("page")))
        found.append(self.issues(days.join(records.select("snapshot_id").distinct(), "snapshot_id", "left_anti"), "warning", "empty_document", F.lit("no records")))
        issues = found[0]
        for more in found[1:]:
            issues = issues.unionByName(more)
        return records, issues
