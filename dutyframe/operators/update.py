"""One pass over all sources: what is published, met with what has landed, parsed, stored, and put on the map."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutyframe.operators import locate, store
from dutyframe.operators.tables import written
from dutyframe.sources.base import Source, SourceFailed

REFERENCE = "source_id string, method string, url string, form string, published_date date, revision int, label string"
PASS = "source_id string, outcome string, documents long, skipped long, failed long, detail string"


def requests(references: DataFrame) -> DataFrame:
    """References with their kind of request: a form is posted, everything else is got; key names the request."""
    for column in ("url", "form"):
        if column not in references.columns:
            references = references.withColumn(column, F.lit(None).cast("string"))
    posted = F.when(F.col("form").isNull(), "GET").otherwise("POST")
    out = references.withColumn("method", posted).withColumn("url", F.coalesce("url", F.lit("")))
    return out.withColumn("key", store.cache_key(F.col("method"), F.col("url"), F.col("form")))


def documents(references: DataFrame, landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(landed documents, references without one). landed: method, url, form and content of each answer.

    Equal requests that landed more than once give a document for each different content.
    """
    asked = requests(references)
    keyed = landed.select(store.cache_key(F.col("method"), F.coalesce("url", F.lit("")), F.col("form")).alias("key"), "content", F.sha2("content", 256).alias("sha256")).dropDuplicates(["key", "sha256"])
    columns = ["source_id", "url", "form", "published_date", "revision", "label"]
    return asked.join(keyed, "key").select(*columns, "sha256", "content"), asked.join(keyed, "key", "left_anti").select(*columns)


def ingest_source(own: store.RecordStore, source: Source, listings: DataFrame, landed: DataFrame, first: str, last: str, batch: int, reparse: bool = False) -> dict[str, int]:
    """The counters of one source: documents of its listings in the window that have landed; those that haven't count as failed.

    A parser gives a document that it can't read as an issue `document_failed`, a row like others; so any error of a job
    here is one of the plan or of the machines, and is raised.
    """
    found, missing = documents(source.discover(listings, first, last), landed)
    absent = missing.select(F.lit(None).cast("long").alias("snapshot_id"), "source_id", F.lit("error").alias("severity"), F.lit("not_landed").alias("code"), F.concat_ws(" ", F.nullif("url", F.lit("")), "form").alias("detail"))

    def with_absent(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        records, issues = source.parse(rows)
        return records, issues.unionByName(absent)

    counts = own.ingest(found, with_absent, batch, reparse, writer=source.id)
    return counts | {"failed": counts["failed"] + missing.count()}


def run_pass(own: store.RecordStore, sources: Iterable[Source], listings: dict[str, DataFrame], landed: DataFrame, first: str, last: str, batch: int, places: DataFrame | None = None) -> DataFrame:
    """A row per source (see PASS) of one pass, and one for locating if anything new has come.

    Sources run in turn, each as a batch of its own. One whose plan can't be made (its documents lack what it
    reads, or it says so by SourceFailed) is told so in its row, and the next one still runs. A job that
    fails is raised: a lost executor or a full disk says nothing about a source. places: query responses (json).
    """
    out = []
    for source in sources:
        try:
            c = ingest_source(own, source, listings[source.id], landed, first, last, batch)
            out.append((source.id, "done", c["documents"], c["skipped"], c["failed"], None))
        except (AnalysisException, SourceFailed) as error:
            out.append((source.id, "failed", 0, 0, 0, str(error).strip().splitlines()[0][:300]))
    if places is not None and any(r[2] for r in out):
        report = {r["outcome"]: r["n"] for r in locate_entities(own, places).collect()}
        detail = ", ".join(f"{report.get(k, 0)} {k}" for k in ("located", "ambiguous", "unmatched"))
        out.append(("locate", "done", sum(report.values()), 0, 0, detail))
    return own.spark.createDataFrame(out, PASS)


def locate_entities(own: store.RecordStore, responses: DataFrame, kind: str = "hospital") -> DataFrame:
    """Places for the stored entities of a kind that lack one: what was found is stored as a version, the counts are returned."""
    lacking = locate.lacking_place(own.entities(), kind)
    change = store.Transaction(own)
    matches = written(locate.match_places(lacking.select("id", "name"), locate.candidates(responses)), "located")
    found = matches.filter("outcome = 'located'")
    placed = locate.set_places(lacking.join(found.select("id"), "id", "left_semi"), found)
    change.put("entity", placed.withColumn("updated_at", F.current_timestamp()))
    change.commit()
    return locate.locate_report(matches)
