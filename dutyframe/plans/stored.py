"""Queries over record stores that are filled from the provided tables: batches with repeats, corrections, failures and a writer that breaks off; one pass over several sources; a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.functions.text import matching_key
from dutyframe.operators import resolve, store, update
from dutyframe.operators.tables import large
from dutyframe.plans.built import _NAME, _cards
from dutyframe.plans.catalog import query
from dutyframe.plans.roles import scratch, table
from dutyframe.sources import registry
from dutyframe.sources.base import ISSUE, RECORD, Source


class Papers(Source):
    """A source whose documents are single lines `key|identity|kind|name|rest`; a line without the bars can't be read."""

    id, group, attribution = "papers", "hospitals", "nobody"

    def discover(self, listings: DataFrame, first: str, last: str) -> DataFrame:
        return listings.select(F.lit(self.id).alias("source_id"), F.col("html").alias("url"), F.lit(None).cast("date").alias("published_date"), F.lit(0).alias("revision"), F.col("html").alias("label"))

    def parse(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        bad = F.size(F.split("content", r"\|")) < 5
        part = lambda k: F.get(F.split("content", r"\|"), F.lit(k))
        given = {"local_id": part(0), "identity": part(1), "kind": part(2), "name": part(3), "name_folded": matching_key(part(3)), "on_date": F.col("published_date"), "payload": F.col("content"), "seq": F.lit(1)}
        kinds = [c.strip().split(" ") for c in RECORD.split(",")]
        records = documents.filter(~bad).select(*[given.get(c, F.col(c) if c in ("snapshot_id", "source_id") else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])
        failed = documents.filter(bad).select("snapshot_id", "source_id", F.lit("error").alias("severity"), F.lit("document_failed").alias("code"), F.concat(F.lit("no line of a paper: "), "label").alias("detail"))
        return records, failed


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers of customers' desks, with the batch that brings each: two spellings of a name, correction numbers, days, some without a day or unreadable."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    team = (c * 7 % 61).cast("string")
    name = F.when(k % 2 == 0, F.concat(F.lit("Ν.Α. «Ομάδα "), team, F.lit("»"))).otherwise(F.concat(F.lit("ΝΑ - ΟΜΑΔΑ "), team))
    line = F.concat_ws("|", c.cast("string"), F.when(c % 3 == 0, "source_key").otherwise("name"), F.when(c % 4 < 2, "hospital").otherwise("pharmacy"), name, k.cast("string"))
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("desk-"), c % 5).alias("source_id"), F.concat(F.lit("paper/"), F.floor(k / 6)).alias("url"), F.when(k % 13 == 0, F.concat(F.lit("torn "), k)).otherwise(line).alias("content"),
        F.when(k % 11 != 0, F.date_add(F.lit("2025-01-01").cast("date"), (k % 40).cast("int"))).alias("published_date"), (k % 3).cast("int").alias("revision"), F.concat(F.lit("no. "), k).alias("label"), (k % 4 + 1).cast("int").alias("batch"), k.alias("k"),
    )
    return rows.withColumn("sha256", F.sha2("content", 256))


#: The same rows in SQL, with the snapshot ids that they get; a draft's place is its snapshot's.
_PAPERS = """p AS (SELECT *, row_number() OVER (ORDER BY batch, published NULLS FIRST, revision, source_id, url, sha) AS snapshot_id FROM (SELECT *, sha256(content) AS sha FROM (
  SELECT o_orderkey AS k, o_custkey AS c, o_custkey * 7 % 61 AS team, o_custkey % 4 < 2 AS hospital, o_custkey % 3 = 0 AS keyed, 'desk-' || o_custkey % 5 AS source_id, 'paper/' || o_orderkey // 6 AS url, o_orderkey % 13 = 0 AS torn,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Ν.Α. «Ομάδα ' || o_custkey * 7 % 61 || '»' ELSE 'ΝΑ - ΟΜΑΔΑ ' || o_custkey * 7 % 61 END AS name,
    CASE WHEN o_orderkey % 13 = 0 THEN 'torn ' || o_orderkey ELSE o_custkey || '|' || CASE WHEN o_custkey % 3 = 0 THEN 'source_key' ELSE 'name' END || '|' || CASE WHEN o_custkey % 4 < 2 THEN 'hospital' ELSE 'pharmacy' END || '|' || name || '|' || o_orderkey END AS content,
    CASE WHEN o_orderkey % 11 <> 0 THEN DATE '2025-01-01' + CAST(o_orderkey % 40 AS INT) END AS published, CAST(o_orderkey % 3 AS INT) AS revision, CAST(o_orderkey % 4 + 1 AS INT) AS batch FROM orders))),
g AS (SELECT * FROM p WHERE NOT torn),
l AS (SELECT k, CASE WHEN keyed THEN min(snapshot_id) OVER (PARTITION BY c) ELSE min(snapshot_id) OVER (PARTITION BY hospital, team) END AS label FROM g),
e AS (SELECT g.*, l.label, dense_rank() OVER (ORDER BY l.label) AS entity_id, last_value(name) OVER (PARTITION BY l.label ORDER BY snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS entity_name,
    published IS NOT NULL AND row_number() OVER (PARTITION BY source_id, published ORDER BY revision DESC, snapshot_id DESC) > 1 AS superseded FROM g JOIN l USING (k))"""

#: The filled stores of a session, which several queries read.
_MADE: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
    if key not in _MADE:
        _MADE[key] = make(spark, sf_dir)
    return _MADE[key]


def _batch(papers: DataFrame, batch: int) -> DataFrame:
    """A batch's papers and some of the one before, again."""
    return papers.filter((F.col("batch") == batch) | ((F.col("batch") == batch - 1) & (F.col("k") % 5 == 0)))


def _fill(spark: SparkSession, sf_dir: str) -> store.RecordStore:
    """Four batches; before the third a writer breaks off between two tables; then one batch again, and a compaction."""
    own, papers = store.RecordStore(spark, scratch(spark, "store")), _papers(spark, sf_dir)
    for batch in range(1, 5):
        if batch == 3:
            broken = store.Transaction(own)
            broken.put("property", own.read("property").withColumn("payload", F.lit("never seen")))
            broken.put("entity", own.read("entity").withColumn("name", F.lit("never seen")))
        own.ingest(_batch(papers, batch), Papers().parse, batch)
    own.ingest(_batch(papers, 4), Papers().parse, 4)
    own.compact()
    return own


def _filled(spark: SparkSession, sf_dir: str) -> store.RecordStore:
    return _once(spark, sf_dir, _fill)


@query(f"""
WITH {_PAPERS} SELECT p.snapshot_id, NOT p.torn AS processed, e.entity_id, e.entity_name AS name, e.superseded, e.content AS payload FROM p LEFT JOIN e USING (k)""")
def store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds in the end: ids undated first, spellings and keys of one entity together, the last corrections alone current."""
    own = _filled(spark, sf_dir)
    said = own.properties().join(large(own.entities().select(F.col("id").alias("entity_id"), "name")), "entity_id")
    marks = own.snapshots().select(F.col("id").alias("snapshot_id"), F.col("processed_at").isNotNull().alias("processed"))
    return marks.join(large(said.select("snapshot_id", "entity_id", "name", "superseded", "payload")), "snapshot_id", "left")


@query(f"""
WITH {_PAPERS}, v AS (SELECT unnest(range(1, 5)) AS version)
SELECT CAST(version AS INT) AS version, (SELECT count(*) FROM p WHERE batch <= version) AS snapshots, (SELECT count(*) FROM g WHERE batch <= version) AS properties, (SELECT count(DISTINCT label) FROM e WHERE batch <= version) AS entities FROM v""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store as readers saw it after each batch."""
    own = _filled(spark, sf_dir)
    out = None
    for version in range(1, 5):
        then = own.at(version)
        tables = {"snapshots": then.snapshots(), "properties": then.properties(), "entities": then.entities()}
        rows = None
        for name, t in tables.items():
            one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(version).alias("version"), F.lit(name).alias("name"), "n")
            rows = one if rows is None else rows.unionByName(one)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("version").pivot("name", ["snapshots", "properties", "entities"]).agg(F.first("n"))


@query(f"""
WITH {_PAPERS} SELECT code, severity, source_id, count(*) AS n FROM (
  SELECT 'document_failed' AS code, 'error' AS severity, source_id FROM p WHERE torn UNION ALL SELECT 'unrecognized_name', 'info', source_id FROM e WHERE snapshot_id = label AND NOT keyed) GROUP BY ALL""")
def store_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by code: a document that fails again has those of its last try; a name is told when a paper first makes an entity of it."""
    return _filled(spark, sf_dir).issues().groupBy("code", "severity", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_PAPERS} SELECT entity_id, arg_min(name, snapshot_id) AS alias, 'ΝΑΟΜΑΔΑ' || any_value(team) AS alias_folded, count(DISTINCT c) AS keys FROM e GROUP BY entity_id""")
def store_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first spelling of each entity's name, and how many keys lead to it."""
    own = _filled(spark, sf_dir)
    keys = own.read("entity_external_id").groupBy("entity_id").agg(F.count_distinct("value").alias("keys"))
    return own.read("entity_alias").select("entity_id", "alias", "alias_folded").join(large(keys), "entity_id")


@query("""
WITH RECURSIVE d AS (SELECT o_orderkey AS t, o_custkey AS c, o_custkey % 4 <> 0 AS named, CASE WHEN o_orderkey % 7 = 0 THEN (o_custkey * 5 + o_orderkey) % 331 ELSE o_custkey * 3 % 331 END AS name FROM orders),
f AS (SELECT c, min(t) AS t, any_value(named) AS named, arg_min(name, t) AS name FROM d GROUP BY c),
u AS (SELECT c, name, min(t) AS t FROM d GROUP BY ALL),
deps AS (SELECT f.c, u.c AS earlier FROM f JOIN u ON u.name = f.name AND u.t < f.t WHERE f.named),
r AS (SELECT c, c AS root FROM f UNION SELECT r.c, deps.earlier FROM r JOIN deps ON deps.c = r.root),
m AS (SELECT r.c, min(f.t) AS label FROM r JOIN f ON f.c = r.root WHERE r.root NOT IN (SELECT c FROM deps) GROUP BY r.c)
SELECT d.t AS draft, dense_rank() OVER (ORDER BY label) AS entity_id, d.t = label AS is_new FROM d JOIN m USING (c)""")
def batch_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as drafts of one batch, without stored state: each finds what earlier ones made, by its customer or by a name that was passed on."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    drafts = table(spark, sf_dir, "orders").select(
        k.alias("draft"), F.lit("s").alias("source_id"), c.cast("string").alias("local_id"), F.lit("hospital").alias("kind"), F.when(k % 7 == 0, (c * 5 + k) % 331).otherwise(c * 3 % 331).cast("string").alias("name_folded"), F.when(c % 4 != 0, "name").otherwise("source_key").alias("identity")
    )
    none = lambda schema: spark.createDataFrame([], schema)
    found = resolve.settle(drafts, none("entity_id long, scheme string, value string"), none("id long, kind string, name_folded string"), none("entity_id long, alias_folded string"), 0, ["draft"])
    return found.select("draft", "entity_id", "is_new")


class _Broken(Papers):
    id = "broken"

    def parse(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        return documents.select("no_such_column"), documents.sparkSession.createDataFrame([], ISSUE)


def _pass(spark: SparkSession, sf_dir: str) -> tuple[store.RecordStore, DataFrame]:
    """One pass over three sources made of suppliers: one fails as a whole, one has lines that are torn or haven't landed, one is a page of cards for each day."""
    own, s, k = store.RecordStore(spark, scratch(spark, "pass")), table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    url = F.concat(F.lit("unit/"), k)
    listing = s.select(k.alias("page_id"), url.alias("html"))
    cards = _cards(spark, sf_dir)
    options = F.array_join(F.collect_list(F.concat(F.lit('<option value="'), "published_date", F.lit('">d</option>'))), "")
    picker = cards.agg(F.concat(F.lit('<select id="Date">'), options, F.lit("</select>")).alias("html")).select(F.lit(1).alias("page_id"), "html")
    line = F.concat_ws("|", k.cast("string"), F.lit("name"), F.lit("hospital"), F.concat(F.lit("Ν. «Μονάδα Q"), k, F.lit("»")), F.lit("x"))
    none = F.lit(None).cast("string")
    landed = s.filter(k % 9 != 4).select(F.lit("GET").alias("method"), url.alias("url"), none.alias("form"), F.when(k % 10 == 3, "torn").otherwise(line).alias("content"))
    posted = cards.select(F.lit("POST").alias("method"), none.alias("url"), F.concat(F.lit("Date="), "published_date").alias("form"), "content")
    value = lambda c: F.struct(c.alias("value"))
    point = F.concat(F.lit("Point("), 23.5 + (k % 16) / 32.0, F.lit(" "), 37.75 + (k % 16) / 64.0, F.lit(")"))
    seen = s.filter(k % 3 < 2).withColumn("twice", F.explode(F.when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    binding = F.struct(value(F.concat(F.lit("http://places/P"), k, "twice")).alias("item"), value(F.concat(F.lit("Μονάδα Q"), k, F.lit(" Αττικής"))).alias("label"), value(point).alias("coord"))
    responses = seen.groupBy((k % 10).alias("page")).agg(F.collect_list(binding).alias("bindings")).select(F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("json"))
    sources = [_Broken(), Papers(), registry.by_id("fsa-attica-pharmacies")]
    listings = {"broken": listing, "papers": listing, "fsa-attica-pharmacies": picker}
    return own, update.run_pass(own, sources, listings, landed.unionByName(posted), "2025-03-01", "2025-03-31", 1, responses)


@query("""
WITH s AS (SELECT s_suppkey % 9 <> 4 AS landed, s_suppkey % 10 = 3 AS torn, s_suppkey % 3 AS places, s_nationkey FROM supplier), l AS (SELECT * FROM s WHERE landed AND NOT torn)
SELECT 'broken' AS source_id, 'failed' AS outcome, 0::BIGINT AS documents, 0::BIGINT AS skipped, 0::BIGINT AS failed, NULL AS located
UNION ALL SELECT 'papers', 'done', count(*) FILTER (landed AND NOT torn), 0, count(*) FILTER (NOT landed OR torn), NULL FROM s
UNION ALL SELECT 'fsa-attica-pharmacies', 'done', count(DISTINCT s_nationkey), 0, 0, NULL FROM s
UNION ALL SELECT 'locate', 'done', count(*), 0, 0, count(*) FILTER (places = 0) || ' located, ' || count(*) FILTER (places = 1) || ' ambiguous, ' || count(*) FILTER (places = 2) || ' unmatched' FROM l""")
def source_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of that pass; lines that are the same document are one."""
    return _once(spark, sf_dir, _pass)[1].withColumn("located", F.when(F.col("source_id") == "locate", F.col("detail"))).drop("detail")


@query(f"""
SELECT 'hospital' AS kind, 'Ν. «Μονάδα Q' || s_suppkey || '»' AS name, CASE WHEN s_suppkey % 3 = 0 THEN 37.75 + (s_suppkey % 16) / 64.0::DOUBLE END AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 23.5 + (s_suppkey % 16) / 32.0::DOUBLE END AS lon, CASE WHEN s_suppkey % 3 = 0 THEN 'wikidata:P' || s_suppkey || 'a' END AS location_source
FROM supplier WHERE s_suppkey % 9 <> 4 AND s_suppkey % 10 <> 3
UNION ALL SELECT 'pharmacy', {_NAME}, CASE WHEN s_suppkey % 7 > 1 THEN 37 + (s_suppkey % 64) / 64.0::DOUBLE END, CASE WHEN s_suppkey % 7 > 1 THEN 23 + (s_suppkey % 32) / 32.0::DOUBLE END, NULL FROM supplier WHERE s_nationkey <> 3 AND s_suppkey % 17 <> 0""")
def located_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities after that pass: a hospital that one place alone matches has its point and where it comes from."""
    return _once(spark, sf_dir, _pass)[0].entities().select("kind", "name", "lat", "lon", "location_source")


@query("""
SELECT 'desk-' || o_custkey % 5 AS source_id, count(*) AS snapshots, count(*) FILTER (o_orderkey % 13 <> 0) AS properties, count(DISTINCT o_custkey) FILTER (o_orderkey % 13 <> 0) AS keys FROM orders WHERE o_orderkey % 4 < 2 GROUP BY ALL""")
def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshes by micro-batches over landed papers, with a restart between: what comes again changes nothing, what is new is added."""
    from dutyframe.streaming import refresh

    own, place, papers = store.RecordStore(spark, scratch(spark, "store")), scratch(spark, "stream"), _papers(spark, sf_dir)
    for batch in (1, 2):
        docs = _batch(papers, batch).drop("batch", "k")
        docs.write.mode("append").parquet(f"{place}/in")
        refresh.refresh(own, refresh.read_landed(spark, f"{place}/in", docs.schema), Papers().parse, f"{place}/check").awaitTermination()
    snaps = own.snapshots().select(F.col("id").alias("snapshot_id"), "source_id")
    said = snaps.join(own.properties(), "snapshot_id", "left").groupBy("source_id").agg(F.count_distinct("snapshot_id").alias("snapshots"), F.count("payload").alias("properties"))
    keys = own.read("entity_external_id").groupBy(F.col("scheme").alias("source_id")).agg(F.count_distinct("value").alias("keys"))
    return said.join(keys, "source_id")
