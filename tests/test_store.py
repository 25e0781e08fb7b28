"""The record store against a model of it in plain Python, and what happens when writers break off, meet, or come again."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dutyframe.operators import resolve, serve, store, supersede, update
from dutyframe.operators.log import CommitLog, Conflict
from dutyframe.plans.stored import Papers
from dutyframe.sources.base import ISSUE, SourceFailed

DAYS = [None, dt.date(2024, 3, 1), dt.date(2024, 3, 2)]
TABLES = ["snapshot", "entity", "entity_alias", "entity_external_id", "property", "ingest_issue", "processed"]


def paper(key, name, url, identity="name", day=1, revision=0, rest="r"):
    return (f"desk-{key % 2}", url, f"{key}|{identity}|hospital|{name}|{rest}", DAYS[day], revision, f"label {url}")


def frame(spark, papers):
    df = spark.createDataFrame(papers, "source_id string, url string, content string, published_date date, revision int, label string")
    return df.withColumn("sha256", F.sha2("content", 256))


def state(own):
    """What a reader sees, without clocks."""
    names = {r["id"]: r["name"] for r in own.entities().collect()}
    said = sorted(((r["snapshot_id"], r["entity_id"], names[r["entity_id"]], r["payload"], r["superseded"]) for r in own.properties().collect()), key=str)
    issues = sorted((str(r["snapshot_id"]), r["code"], r["detail"]) for r in own.issues().collect())
    aliases = sorted((r["entity_id"], r["alias"]) for r in own.read("entity_alias").collect())
    keys = sorted((r["scheme"], r["value"], r["entity_id"]) for r in own.read("entity_external_id").collect())
    done = sorted((r["id"], r["url"], r["processed_at"] is not None) for r in own.snapshots().collect())
    return said, issues, aliases, keys, done, len(names)


class Model:
    """One document after the other, one draft each."""

    def __init__(self):
        self.snapshots, self.said, self.by_key, self.by_name, self.names, self.done, self.issues = {}, {}, {}, {}, {}, set(), {}

    def take(self, papers):
        told = {"seen": 0, "documents": 0, "failed": 0, "skipped": 0}
        unique = {(p[0], p[1], p[2]): p for p in papers}
        digest = lambda p: __import__("hashlib").sha256(p[2].encode()).hexdigest()
        order = sorted(unique.values(), key=lambda p: (p[3] is not None, p[3] or dt.date.min, p[4], p[0], p[1], digest(p)))
        told["seen"] = len(order)
        todo = [p for p in order if (p[0], p[1], p[2]) not in self.done]
        told["skipped"] = len(order) - len(todo)
        for p in todo:
            self.snapshots.setdefault((p[0], p[1], p[2]), (len(self.snapshots) + 1, p))
        for p in sorted(todo, key=lambda p: (p[3] is not None, p[3] or dt.date.min, p[4], self.snapshots[p[0], p[1], p[2]][0])):
            key = (p[0], p[1], p[2])
            number = self.snapshots[key][0]
            parts = p[2].split("|")
            if len(parts) < 5:
                told["failed"] += 1
                self.issues[number] = "document_failed"
                continue
            local, identity, name = (p[0], parts[0]), parts[1], parts[3].replace(".", "").upper()
            found = self.by_key.get(local)
            if found is None and identity == "name":
                found = self.by_name.get(name)
            if found is None:
                found = len(self.names) + 1
                if identity == "name":
                    self.issues[number] = "unrecognized_name"
            self.by_key.setdefault(local, found)
            self.by_name[name] = min(found, self.by_name.get(name, found))
            self.names[found] = parts[3]
            self.said[number] = (found, p)
            self.done.add(key)
            told["documents"] += 1
        return told

    def state(self):
        top = {}
        for number, (_, p) in self.said.items():
            if p[3] is not None:
                top[p[0], p[3]] = max((p[4], number), top.get((p[0], p[3]), (-1, 0)))
        said = sorted(((n, e, self.names[e], p[2], p[3] is not None and top[p[0], p[3]][1] != n) for n, (e, p) in self.said.items()), key=str)
        return said, sorted((str(k), v) for k, v in self.issues.items())


def drawn(seed):
    """Batches of papers with repeats, corrections, torn ones and names in several spellings; one name for each key."""
    r = random.Random(seed)
    names = {k: f"Κ.Ν. N{k % 6}" for k in range(12)}
    batches = []
    for b in range(3):
        batch = []
        for _ in range(r.randrange(4, 12)):
            k = r.randrange(12)
            p = paper(k, names[k].replace(".", "") if r.random() < 0.4 else names[k], f"u{r.randrange(6)}", "name" if k % 3 else "source_key", r.randrange(3), r.randrange(3), f"r{r.randrange(3)}")
            batch.append(p if r.random() < 0.85 else (*p[:2], f"torn {b}{r.randrange(3)}", *p[3:]))
        batches.append(batch + (r.sample(batches[-1], 2) if batches else []))
    return batches


def test_batches_equal_the_model(spark, tmp_path):
    own, model = store.RecordStore(spark, str(tmp_path / "s")), Model()
    for n, batch in enumerate(drawn(1), 1):
        unique = list({(p[0], p[1], p[2]): p for p in batch}.values())  # days and numbers of one document are one
        assert own.ingest(frame(spark, unique), Papers().parse, n) == model.take(unique)
        said, issues, *_ = state(own)
        assert (said, [i[:2] for i in issues]) == model.state()
    before = state(own)
    assert own.compact() == 4 and state(own) == before
    assert all(len(v) == 1 for v in own.log.read()["tables"].values())
    gone = own.vacuum()
    assert gone and own.log.versions() == [4] and state(own) == before
    assert sum(len(own.log.folders(t)) for t in TABLES) == len(TABLES)


def test_a_writer_that_breaks_off_leaves_nothing(spark, tmp_path, monkeypatch):
    """Whatever table the writer was at: readers see the version before, and the batch, tried again, makes what it would have made."""
    first, second = drawn(2)[:2]
    whole = store.RecordStore(spark, str(tmp_path / "whole"))
    for n, batch in enumerate((first, second), 1):
        whole.ingest(frame(spark, batch), Papers().parse, n)
    own = store.RecordStore(spark, str(tmp_path / "torn"))
    own.ingest(frame(spark, first), Papers().parse, 1)
    before = state(own)
    put = store.Transaction.put
    for table in ("entity", "property", "processed"):

        def fails(self, name, rows, table=table):
            if name == table:
                raise OSError("the disk is full")
            return put(self, name, rows)

        monkeypatch.setattr(store.Transaction, "put", fails)
        with pytest.raises(OSError, match="full"):
            own.ingest(frame(spark, second), Papers().parse, 2)
        assert own.log.versions() == [1] and state(own) == before
    monkeypatch.setattr(store.Transaction, "put", put)
    own.ingest(frame(spark, second), Papers().parse, 2)
    assert state(own) == state(whole)
    assert len(own.vacuum()) == 0 or state(own) == state(whole)


def test_a_batch_again_and_a_batch_too_late(spark, tmp_path):
    own = store.RecordStore(spark, str(tmp_path / "s"))
    told = own.ingest(frame(spark, [paper(1, "A", "u")]), Papers().parse, 5)
    assert own.ingest(frame(spark, [paper(1, "A", "u"), paper(2, "B", "v")]), Papers().parse, 5) == told and own.log.versions() == [1]
    with pytest.raises(ValueError):
        own.ingest(frame(spark, []), Papers().parse, 4)
    assert own.ingest(frame(spark, []), Papers().parse, 4, writer="another") == {"seen": 0, "documents": 0, "skipped": 0, "failed": 0}


def test_of_two_writers_the_second_is_refused(spark, tmp_path):
    own = store.RecordStore(spark, str(tmp_path / "s"))
    one, two = store.Transaction(own), store.Transaction(own)
    alias = lambda name: spark.createDataFrame([(1, name, name)], "entity_id long, alias string, alias_folded string")
    one.put("entity_alias", alias("one"))
    two.put("entity_alias", alias("two"))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert [r["alias"] for r in own.read("entity_alias").collect()] == ["one"] and {f.name.strip(".").split(".")[0] for f in (tmp_path / "s" / "_log").iterdir()} == {f"{1:020d}"}
    again = store.Transaction(own)
    again.put("entity_alias", alias("two"))
    assert again.commit() == 2 and own.read("entity_alias").count() == 2 and own.at(1).read("entity_alias").count() == 1


def test_parsed_again_a_document_replaces_what_it_said(spark, tmp_path):
    own = store.RecordStore(spark, str(tmp_path / "s"))
    docs = frame(spark, [paper(1, "A", "u"), paper(2, "B", "v")])
    own.ingest(docs, Papers().parse, 1)

    class Louder(Papers):
        def parse(self, documents):
            records, issues = super().parse(documents)
            loud = records.withColumn("payload", F.upper("payload"))
            told = documents.select("snapshot_id", "source_id", F.lit("warning").alias("severity"), F.lit("loud").alias("code"), F.lit("x").alias("detail"))
            return loud, issues.unionByName(told.filter(F.col("content").contains("|A|")) if "content" in documents.columns else told)

    assert own.ingest(docs, Louder().parse, 2, reparse=True) == {"seen": 2, "documents": 2, "skipped": 0, "failed": 0}
    assert sorted(r["payload"] for r in own.properties().collect()) == ["1|NAME|HOSPITAL|A|R", "2|NAME|HOSPITAL|B|R"]
    # a document with new issues has these, one without keeps those it had
    assert sorted(r["code"] for r in own.issues().collect()) == ["loud", "unrecognized_name"]
    assert own.entities().count() == 2 and own.at(1).properties().count() == 2
    before = state(own)
    own.compact()
    assert state(own) == before and own.read("property").count() == 2


def test_many_versions_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT_AFTER", 2)
    own = store.RecordStore(spark, str(tmp_path / "s"))
    for n in range(1, 5):
        own.ingest(frame(spark, [paper(n, f"N{n}", "u")]), Papers().parse, n)
    assert max(len(v) for v in own.log.read()["tables"].values()) <= 2
    assert own.properties().count() == 4 and own.entities().count() == 4


def test_a_log_of_nothing(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "n"))
    assert log.versions() == [] and log.read()["version"] == 0 and log.folders("entity") == []
    own = store.RecordStore(spark, str(tmp_path / "n"))
    assert all(own.read(t).isEmpty() for t in TABLES) and own.properties().isEmpty() and own.issues().isEmpty()


class Unready(Papers):
    id = "unready"

    def parse(self, documents):
        raise SourceFailed("the page has another form now")


class OutOfDisk(Papers):
    """What a lost machine looks like: a task fails whatever the document is."""

    id = "sick"

    def parse(self, documents):
        sick = F.udf(lambda x: (_ for _ in ()).throw(OSError("No space left on device")), "string")
        return super().parse(documents.withColumn("content", sick("content")))


def a_pass(spark, own, *sources):
    listing = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "page_id int, html string")
    landed = spark.createDataFrame([("GET", "a", None, "1|name|hospital|A|x"), ("GET", "b", None, "torn")], "method string, url string, form string, content string")
    return update.run_pass(own, sources, {s.id: listing for s in sources}, landed, "2024-01-01", "2024-01-02", 1)


def test_a_bad_document_and_a_bad_source_are_told_apart(spark, tmp_path):
    own = store.RecordStore(spark, str(tmp_path / "s"))
    got = {r["source_id"]: tuple(r)[1:] for r in a_pass(spark, own, Unready(), Papers()).collect()}
    assert got["papers"][:4] == ("done", 1, 0, 2) and got["unready"][0] == "failed" and "another form" in got["unready"][4]
    assert sorted(r["code"] for r in own.issues().collect()) == ["document_failed", "not_landed", "unrecognized_name"]


def test_a_failing_machine_is_raised_and_recorded_nowhere(spark, tmp_path):
    own = store.RecordStore(spark, str(tmp_path / "s"))
    with pytest.raises(PySparkException, match="No space left"):
        a_pass(spark, own, OutOfDisk(), Papers())
    assert own.log.versions() == [] and own.issues().isEmpty()
    assert a_pass(spark, own, Papers()).first()["documents"] == 1  # the same batch, tried again


def test_streamed_batches_count_once(spark, tmp_path):
    from dutyframe.streaming import refresh

    own, place = store.RecordStore(spark, str(tmp_path / "s")), str(tmp_path / "in")
    docs = frame(spark, [paper(1, "A", "u"), paper(2, "B", "v")])
    for n in (2, 2, 3):
        docs.unionByName(frame(spark, [paper(3, "C", "w")])).limit(n).write.mode("append").parquet(place)
        stream = refresh.read_landed(spark, place, docs.schema)
        refresh.refresh(own, stream, Papers().parse, str(tmp_path / "check")).awaitTermination()
        assert own.properties().count() == n
    assert own.log.read()["writers"][str(tmp_path / "check")]["batch"] == 2
    other = store.RecordStore(spark, str(tmp_path / "other"))  # an interval instead: the first tick at once
    query = refresh.refresh(other, stream, Papers().parse, str(tmp_path / "check2"), once=False, every="1 second")
    try:
        end = time.time() + 60
        while not other.log.versions() and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert other.properties().count() == 3


def test_rising_revisions_forget_and_recover(spark, tmp_path):
    """Highest revisions over restarts; a key without news for the horizon is forgotten, and rows later than the watermark are dropped."""
    from dutyframe.streaming import refresh

    refresh.state_store(spark)
    place, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "k string, revision long, id long, at timestamp"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    runs = [
        [("a", 1, 1, day(0)), ("a", 0, 9, day(1)), ("b", 5, 2, day(1)), ("c", None, 3, day(1)), (None, 1, 4, day(1))],
        [("a", 1, 3, day(2)), ("a", 0, 10, day(2)), ("b", 4, 11, day(3))],
        [("b", 6, 12, day(40)), ("a", 9, 99, day(5))],
        [("b", 6, 13, day(41))],
        [("a", 0, 20, day(42))],
    ]
    told = []
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
        rising = refresh.rising_revisions(spark.readStream.schema(schema).parquet(place), ["k"], "revision", "id", "at")
        refresh.keep_batches(rising, out, check).awaitTermination()
        now = sorted((tuple(r) for r in spark.read.schema(rising.schema).parquet(out).select("k", "revision", "id").collect()), key=str)
        told.append([r for r in now if r not in sum(told, [])])
    assert told[0] == sorted([("a", 1, 1), ("b", 5, 2), (None, 1, 4)], key=str)
    assert told[1] == [("a", 1, 3)]
    assert ("b", 6, 12) in told[2] and told[3] == [("b", 6, 13)]
    assert told[4] == [("a", 0, 20)]  # a was forgotten


def test_rising_revisions_of_many_keys_are_compared_at_once():
    """A thousand keys of a bucket cost one read and one write of its state; each is forgotten at its own time."""
    from types import SimpleNamespace

    import pandas as pd

    from dutyframe.streaming import refresh

    told = {"held": None, "calls": 0, "timers": set()}

    def update(v):
        told.update(held=v, calls=told["calls"] + 1)

    def get():
        told["calls"] += 1
        return told["held"]

    state = SimpleNamespace(exists=lambda: told["held"] is not None, get=get, update=update, clear=lambda: told.update(held=None))
    own = refresh.LatestRevision()
    own.init(SimpleNamespace(getValueState=lambda *_: state, registerTimer=told["timers"].add, deleteTimer=told["timers"].remove))
    rows = lambda revision, until, n=1000: pd.DataFrame({"name": [str(k) for k in range(n)], "top": [revision + k % 2 for k in range(n)], "row": range(n), "until": [until + k for k in range(n)], "whole": True})
    risen = lambda *parts: sum(len(p) for p in own.handleInputRows((0,), iter(parts), None))
    assert risen(rows(5, 100), rows(4, 50)) == 1000 and told["calls"] == 1 and told["timers"] == {100}
    assert risen(rows(5, 100)) == 0 and told["calls"] == 2
    assert risen(rows(4, 90), rows(6, 70, 10)) == 10 and told["calls"] == 4 and told["timers"] == {100}
    for now, left, due in ((500, 600, {500}), (1100, None, set())):
        (rung,) = told["timers"]
        list(own.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), SimpleNamespace(getExpiryTimeInMs=lambda rung=rung: rung)))
        told["timers"].remove(rung)  # as Spark does
        assert (told["held"] and len(told["held"][0])) == left and told["timers"] == due


def test_rising_revisions_keep_long_numbers(spark, tmp_path):
    """Ids beyond 2**53 stay exact beside rows without one, as do keys of several types, null among them."""
    from dutyframe.streaming import refresh

    refresh.state_store(spark)
    place, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "a long, b timestamp, revision long, id long, at timestamp"
    now, big = dt.datetime(2024, 1, 1, 0, 0, 0, 7), 2**53 + 1
    spark.createDataFrame([(big, now, 1, big, now), (big, now, None, 5, now), (None, now, big, 1, now), (None, now, 3, None, now)], schema).coalesce(1).write.parquet(place)
    rising = refresh.rising_revisions(spark.readStream.schema(schema).parquet(place), ["a", "b"], "revision", "id", "at")
    refresh.keep_batches(rising, out, str(tmp_path / "check")).awaitTermination()
    found = spark.read.schema(rising.schema).parquet(out).select("a", "b", "revision", "id").collect()
    assert {tuple(r) for r in found} == {(big, now, 1, big), (None, now, big, 1)}


def test_a_document_is_sought_by_its_identity_once(spark, tmp_path):
    """The parser's input is no join by url and hash: ids come with the texts, and those that failed before meet the marks by id."""
    own, plans = store.RecordStore(spark, str(tmp_path / "s")), []

    def parse(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return Papers().parse(rows)

    torn = ("desk-1", "u9", "torn", DAYS[1], 0, "l")
    own.ingest(frame(spark, [paper(1, "A", "u1"), torn]), parse, 1)
    told = own.ingest(frame(spark, [paper(1, "A", "u1"), torn, paper(3, "B", "u2", day=0)]), parse, 2)
    assert told == {"seen": 3, "documents": 1, "skipped": 1, "failed": 1}
    assert {(r["id"], r["url"], r["processed_at"] is not None) for r in own.snapshots().collect()} == {(1, "u1", True), (2, "u9", False), (3, "u2", True)}
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    assert joins and not any("sha256" in line or "url" in line for line in joins)


def broadcasts(spark, work, monkeypatch):
    """The plans of what work runs that gather a table in the driver, besides the few rows that the code itself says are few."""
    executions = lambda: {e.executionId(): e for e in (seen.apply(k) for k in range(seen.size()))}
    bus, status = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    seen = status.executionsList()
    before = set(executions())
    monkeypatch.setattr(F, "broadcast", lambda df: df.hint("merge"))
    work()
    monkeypatch.undo()
    bus.waitUntilEmpty(30_000)
    seen = status.executionsList()
    plans = [e.physicalPlanDescription() for k, e in executions().items() if k not in before]
    assert plans
    return [p for p in plans if "BroadcastExchange" in p]


def test_no_table_of_the_store_is_gathered_in_the_driver(spark, tmp_path, monkeypatch):
    """Files of ids and equal dates are small for millions of rows, so no size of a file lets the driver take one whole."""
    own = store.RecordStore(spark, str(tmp_path))

    def work():
        for batch in (1, 2):
            own.ingest(frame(spark, [paper(k, f"n{k % 3}", f"u{k}") for k in range(batch, 8)]), Papers().parse, batch)
        own.compact()
        for rows in (own.snapshots(), own.properties(), own.issues()):
            rows.write.format("noop").mode("overwrite").save()

    assert broadcasts(spark, work, monkeypatch) == []


@pytest.mark.parametrize("name", ["store_state", "store_aliases"])
def test_no_table_of_a_filled_store_is_gathered_in_the_driver(spark, sf, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_superseded_rows_stay(spark):
    snaps = spark.createDataFrame([(k, "s", DAYS[d], n) for k, d, n in ((1, 1, 2), (2, 1, 0), (3, 1, 2), (4, 0, 0), (5, 0, 0), (6, 2, 0))], "id long, source_id string, published_date date, revision int")
    rows = spark.createDataFrame([(k,) for k in (*range(1, 7), 9)], "snapshot_id long")
    assert {r[0] for r in supersede.flag_superseded(rows, supersede.current_snapshots(snaps)).filter("not superseded").collect()} == {3, 4, 5, 6}


def test_nearest_first_and_by_name(spark):
    day = dt.date(2024, 1, 1)
    said = spark.createDataFrame([(k, 1, day if k != 4 else DAYS[1], None, None, "{}", k == 5) for k in range(1, 7)], "entity_id long, snapshot_id long, on_date date, starts_at timestamp_ntz, ends_at timestamp_ntz, payload string, superseded boolean")
    ents = spark.createDataFrame([(1, "pharmacy", "β", 38.0, 24.01), (2, "pharmacy", "α", 38.0, 24.02), (3, "hospital", "γ", None, None), (4, "hospital", "δ", 38.0, 24.0), (5, "hospital", "ε", 38.0, 24.0), (6, "hospital", "ζ", 38.0, 24.2)], "id long, kind string, name string, lat double, lon double")
    snaps = spark.createDataFrame([(1, "s", "u")], "id long, source_id string, url string")
    told = lambda **how: "".join(r["name"] for r in serve.on_call(said, ents, snaps, day, **how).collect())
    assert (told(), told(near=(38.0, 24.0)), told(near=(38.0, 24.0), radius_km=40), told(kind="hospital"), told(limit=2), told(limit=0)) == ("αβγζ", "βα", "βαζ", "γζ", "αβ", "α")


def test_new_ids_are_shared_by_identity(spark):
    rows = [("s", f"{k}", kind, "X", identity, None) for k in range(2) for kind, identity in (("hospital", "name"), ("pharmacy", "source_key"))] + [("s", "7", "hospital", "Y", "name", 3)]
    got = resolve.with_new_ids(spark.createDataFrame(rows, "source_id string, local_id string, kind string, name_folded string, identity string, entity_id long"), 4).collect()
    assert sorted((r["kind"], r["name_folded"], r["is_new"]) for r in got if r["entity_id"] > 4) and sorted({r["entity_id"] for r in got}) == [3, 5, 6, 7]
    assert len({r["entity_id"] for r in got if r["kind"] == "hospital" and r["is_new"]}) == 1 and ISSUE
