"""The record store: parquet tables in versions of a commit log, and the ingest step.

A document is ingested once: snapshots are told apart by source, url and content hash, and only
those without a processed mark are parsed. A batch of documents is one version of all tables.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.operators import resolve, schemas, supersede
from dutyframe.operators.log import CommitLog, Conflict
from dutyframe.operators.tables import CODEC, large, written

IDENTITY = ["source_id", "url", "sha256"]
#: A table of more folders than this is compacted; so a manifest stays small.
COMPACT_AFTER = 50


def content_hash(content) -> object:
    return F.sha2(content, 256)


def cache_key(method, url, body) -> object:
    """Key of a request: method, url and body."""
    return F.sha2(F.concat(method, F.lit("\n"), url, F.lit("\n"), F.coalesce(body, F.lit(""))).cast("binary"), 256)


def safe_namespace(text) -> object:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def stricter(policy, hint) -> object:
    """Of two cache policies: cache_only absorbs, else the more eager of prefer_cache, revalidate and force."""
    rank = lambda p: F.array_position(F.array(*[F.lit(x) for x in ("cache_only", "prefer_cache", "revalidate", "force")]), p)
    return F.when((policy == "cache_only") | (hint == "cache_only"), "cache_only").when(rank(policy) >= rank(hint), policy).otherwise(hint)


def cache_hint(volatile, has_form) -> object:
    return F.when(~volatile, "prefer_cache").when(has_form, "force").otherwise("revalidate")


def new_documents(documents: DataFrame, snapshots: DataFrame, reparse: bool = False) -> DataFrame:
    """Documents to parse, one per identity: those of no processed snapshot, or all of them."""
    one = documents.dropDuplicates(IDENTITY)
    if reparse:
        return one
    done = snapshots.filter(F.col("processed_at").isNotNull()).select(*IDENTITY)
    return one.join(done, IDENTITY, "left_anti")


def backfill_processed(snapshots: DataFrame, properties: DataFrame) -> DataFrame:
    """Snapshots that have properties count as processed when they were fetched."""
    having = properties.select(F.col("snapshot_id").alias("id")).distinct().withColumn("__has", F.lit(True))
    joined = snapshots.join(having, "id", "left")
    return joined.withColumn("processed_at", F.coalesce("processed_at", F.when(F.col("__has"), F.col("fetched_at")))).drop("__has")


def first_fetches(documents: DataFrame, content: str, key: str = "id") -> DataFrame:
    """sha256, the first key and the number of fetches of each different content."""
    hashed = documents.select(key, content_hash(F.col(content)).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def ingest_report(outcomes: DataFrame) -> DataFrame:
    """Counters per source from a row per document: source_id, outcome, entities, properties, warnings."""
    return outcomes.groupBy("source_id").agg(
        F.count_if(F.col("outcome") == "parsed").alias("documents"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.sum("entities").alias("entities"),
        F.sum("properties").alias("properties"),
        F.sum("warnings").alias("warnings"),
    )


def run_summary(report: DataFrame) -> DataFrame:
    return report.agg(*[F.sum(c).alias(c) for c in ("documents", "skipped", "failed")])


class Transaction:
    """What one writer adds to the version it has seen; nothing is seen of it before it is committed."""

    def __init__(self, own: RecordStore):
        self.own, self.base = own, own.log.read()
        self.version = self.base["version"] + 1
        self.tables = {k: list(v) for k, v in self.base["tables"].items()}

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"{name}/{self.version:020d}-{uuid.uuid4().hex}"
        rows.write.option("compression", CODEC).parquet(self.own.path(folder))
        return folder

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows to a table; what was written, read again."""
        columns = [c.strip().split(" ")[0] for c in schemas.TABLES[name].split(",")]
        folder = self._write(name, rows.select(*columns).withColumn("version", F.lit(self.version).cast("long")))
        self.tables.setdefault(name, []).append(folder)
        return self.own.folders_of(name, [folder])

    def replace(self, name: str, rows: DataFrame) -> None:
        """rows (with their versions) instead of all that a table holds."""
        self.tables[name] = [self._write(name, rows)]

    def commit(self, writer: str | None = None, batch: int | None = None, told: dict | None = None) -> int:
        writers = dict(self.base["writers"])
        if writer is not None:
            writers[writer] = {"batch": batch, "told": told}
        self.own.log.commit({"version": self.version, "tables": self.tables, "writers": writers})
        return self.version


class RecordStore:
    """Tables under one folder, in versions: a reader sees those of one version, the last or a given one.

    Rows carry the version that wrote them. Of an entity the last version counts; of a document's properties those of the
    version that parsed it last; of its issues those of the last version that had any. A table of more than COMPACT_AFTER folders is compacted after a commit.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.log = CommitLog(spark, root)

    def at(self, version: int) -> RecordStore:
        """The store as it was at a version, for reading."""
        return RecordStore(self.spark, self.root, version)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def folders_of(self, name: str, folders: list[str]) -> DataFrame:
        schema = schemas.TABLES[name] + ", version long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.path(f) for f in folders])

    def read(self, name: str) -> DataFrame:
        """All rows of a table at the store's version, with the versions that wrote them."""
        return self.folders_of(name, self.log.read(self.version)["tables"].get(name, []))

    def marks(self) -> DataFrame:
        """snapshot_id, processed_at (the first time) and version (the last time) of each processed document."""
        return self.read("processed").groupBy("snapshot_id").agg(F.min("processed_at").alias("processed_at"), F.max("version").alias("version"))

    def snapshots(self) -> DataFrame:
        return self.read("snapshot").drop("version").join(large(self.marks().select(F.col("snapshot_id").alias("id"), "processed_at")), "id", "left")

    def _entity(self) -> DataFrame:
        return supersede.latest(self.read("entity"), ["id"], ["version"])

    def entities(self) -> DataFrame:
        """The last version of each entity."""
        return self._entity().drop("version")

    def _property(self) -> DataFrame:
        return self.read("property").join(large(self.marks().select("snapshot_id", "version")), ["snapshot_id", "version"], "left_semi")

    def properties(self) -> DataFrame:
        """What each document said when it was parsed last, with superseded."""
        served = supersede.current_snapshots(self.snapshots().filter(F.col("processed_at").isNotNull()))
        return supersede.flag_superseded(self._property().drop("version"), large(served))

    def _issue(self) -> DataFrame:
        rows = self.read("ingest_issue")
        last = rows.filter("snapshot_id is not null").groupBy("snapshot_id").agg(F.max("version").alias("version"))
        return rows.filter("snapshot_id is null").unionByName(rows.join(large(last), ["snapshot_id", "version"], "left_semi"))

    def issues(self) -> DataFrame:
        """The issues of each document that were recorded last, and all that belong to none."""
        return self._issue().drop("version")

    def compact(self, tables: list[str] | None = None) -> int:
        """A version with one folder for each table, without rows that no reader of it sees."""
        t = Transaction(self)
        kept = {"entity": self._entity, "property": self._property, "ingest_issue": self._issue, "processed": self.marks}
        for name in tables or list(t.tables):
            rows = kept.get(name, lambda name=name: self.read(name))()
            t.replace(name, rows.select(*self.read(name).columns))
        return t.commit()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete manifests but the last `keep`, and the folders that none of those names; the names of the folders.

        Folders newer than the last version may belong to a writer that is at work, and stay.
        """
        there = self.log.versions()
        live = {f for v in there[-keep:] for folders in self.log.read(v)["tables"].values() for f in folders}
        gone = [f"{t}/{f}" for t in schemas.TABLES for f in self.log.folders(t) if f"{t}/{f}" not in live and int(f.split("-")[0]) <= there[-1]]
        for v in there[:-keep]:
            self.log.delete(f"_log/{v:020d}.json")
        for name in gone:
            self.log.delete(name)
        return gone

    def ingest(self, documents: DataFrame, parse, batch: int, reparse: bool = False, writer: str = "ingest") -> dict[str, int]:
        """One batch of raw documents (source_id, url, sha256, content, published_date, revision, label), as one version.

        parse takes the new ones with snapshot_id and gives (records, issues): records with source_id,
        local_id, kind, name, name_folded, identity, address, municipality, lat, lon, phone, on_date,
        starts_at, ends_at, payload, snapshot_id and seq. Failed documents are those of an issue
        `document_failed`; they get no processed mark and are tried again. A document that is parsed again replaces what it said before.

        Rows of one source, url and hash are one document; where they differ in the rest, any of them is taken.

        A writer's batches count upwards; the last one again changes nothing and tells what it told. A batch that broke
        off has left nothing; Conflict tells that another writer came first, and the batch may be tried again.
        Counters are those of written tables.
        """
        t = Transaction(self)
        last = t.base["writers"].get(writer)
        if last is not None and batch <= last["batch"]:
            if batch < last["batch"]:
                raise ValueError(f"{writer} has committed batch {last['batch']}; batch {batch} comes too late")
            return last["told"]
        now = F.current_timestamp()
        seen_at = self.at(t.base["version"]) if t.base["version"] else self
        known = seen_at.read("snapshot").select(F.col("id").alias("snapshot_id"), *IDENTITY)
        one = written(documents.dropDuplicates(IDENTITY).join(large(known), IDENTITY, "left"), "seen")
        again = one.filter("snapshot_id is not null")
        if not reparse:  # ids alone meet the marks, and only of documents that have come before
            again = written(again.join(large(seen_at.read("processed").select("snapshot_id")), "snapshot_id", "left_anti"), "again")
        # ids are dense in the order of date and revision, undated first; texts go along, so that no document is sought by its identity again
        unseen = one.filter("snapshot_id is null").drop("snapshot_id").sort(F.col("published_date").asc_nulls_first(), "revision", *IDENTITY)
        unseen = written(unseen.withColumn("__row", F.monotonically_increasing_id()), "unseen")
        top = known.agg(F.max("snapshot_id")).first()[0] or 0
        made = resolve.dense_ids(unseen, "__row", "snapshot_id", top)
        t.put("snapshot", made.select(F.col("snapshot_id").alias("id"), *IDENTITY, now.alias("fetched_at"), "published_date", "revision", "label"))
        fresh = made.unionByName(again.select(*made.columns))
        records, issues = parse(fresh)
        records, issues = written(records, "records"), written(issues.select("snapshot_id", "source_id", "severity", "code", "detail"), "issues")
        order = fresh.select("snapshot_id", F.struct("published_date", "revision", "snapshot_id").alias("__document"))
        entities = seen_at.entities()
        base = entities.agg(F.max("id")).first()[0] or 0
        drafts = records.join(large(order), "snapshot_id")
        done = resolve.settle(drafts, seen_at.read("entity_external_id"), entities, seen_at.read("entity_alias"), base, ["__document", "seq"])
        fill = ["address", "municipality", "lat", "lon", "phone"]
        kinds = done.groupBy(F.col("entity_id").alias("id")).agg(F.min("kind").alias("__kind"))
        touched = entities.join(large(kinds.select("id")), "id", "left_semi")
        after = resolve.upsert(touched, done.select(F.col("entity_id").alias("id"), "name", "__order", *fill), fill, "__order").join(large(kinds), "id")
        t.put("entity", after.withColumns({"kind": F.coalesce("kind", "__kind"), "created_at": F.coalesce("created_at", now), "updated_at": now}))
        held = done.groupBy(F.col("source_id").alias("scheme"), F.col("local_id").alias("value"), "kind").agg(F.min("entity_id").alias("entity_id"))
        have = seen_at.read("entity_external_id").select("scheme", "value", "entity_id")
        t.put("entity_external_id", held.join(large(have), ["scheme", "value", "entity_id"], "left_anti"))
        aliases = resolve.first_aliases(done.select("entity_id", F.col("name").alias("alias"), F.col("__order").alias("seq")))
        t.put("entity_alias", aliases.join(large(seen_at.read("entity_alias")), ["entity_id", "alias_folded"], "left_anti"))
        t.put("property", done.select("entity_id", "snapshot_id", F.lit("on_call").alias("kind"), "on_date", "starts_at", "ends_at", "payload"))
        new = done.filter("is_new and identity = 'name'").select("snapshot_id", "source_id", F.lit("info").alias("severity"), F.lit("unrecognized_name").alias("code"), F.col("name").alias("detail"))
        t.put("ingest_issue", issues.unionByName(new).withColumn("created_at", now))
        failed = issues.filter("code = 'document_failed'").select("snapshot_id")
        parsed = t.put("processed", fresh.select("snapshot_id").join(large(failed), "snapshot_id", "left_anti").withColumn("processed_at", now)).count()
        counts = {"seen": one.count(), "documents": parsed}
        counts["skipped"] = 0 if reparse else counts["seen"] - fresh.count()
        counts["failed"] = counts["seen"] - counts["skipped"] - parsed
        t.commit(writer, batch, counts)
        crowded = [name for name, folders in t.tables.items() if len(folders) > COMPACT_AFTER]
        if crowded:
            with contextlib.suppress(Conflict):  # another writer's turn; the next batch compacts
                self.compact(crowded)
        return counts
