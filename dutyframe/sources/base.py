"""What a source of documents is: discovery of what to fetch, and a pure parse of what was fetched."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "snapshot_id long, source_id string, local_id string, kind string, name string, name_folded string, identity string, address string, municipality string, lat double, lon double, phone string, on_date date, starts_at timestamp_ntz, ends_at timestamp_ntz, payload string, seq long"
ISSUE = "snapshot_id long, source_id string, severity string, code string, detail string"


class SourceFailed(Exception):
    """A source can't be read at all, for a reason of its own."""


class Source(ABC):
    """discover: listing pages (page_id, html) to document references; parse: documents to (records, issues).

    parse never lets one document break the others: a document that can't be read is an issue `document_failed`.
    """

    id: str
    group: str
    attribution: str

    @abstractmethod
    def discover(self, listings: DataFrame, first: str, last: str) -> DataFrame: ...

    @abstractmethod
    def parse(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]: ...

    def issues(self, rows: DataFrame, severity: str, code: str, detail) -> DataFrame:
        return rows.select("snapshot_id", F.lit(self.id).alias("source_id"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))
