"""The refresh loop: new documents in micro-batches, exactly once, and running latest revisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dutyframe.operators.store import RecordStore

REFRESH = "3 hours"
#: A day's records may be corrected from a day before it to seven after: what is older than this isn't awaited.
HORIZON = "9 days"
#: Keys are dealt into so many parts of the state. A task holds the keys of one.
BUCKETS = 1024
#: Keys go through Python as JSON, whatever their types; times in it keep their microseconds.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def latest_revisions(stream: DataFrame, keys: list[str], revision: str, key: str) -> DataFrame:
    """keys and the highest (revision, key) so far; an older revision that comes later changes nothing."""
    return stream.groupBy(*keys).agg(F.max(F.struct(revision, key)).alias("top")).select(*keys, f"top.{revision}", f"top.{key}")


class LatestRevision(StatefulProcessor):
    """Of each key the highest (revision, id) so far, told whenever it rises; a key that nothing has come for is forgotten after a time.

    The state is kept by bucket of keys: calls for each key would cost far more than the work itself, so a bucket's keys are read, compared and written at once.
    Rows: name, top, row, until (ms; 0: no time is known) and whole (revision and id aren't null).
    """

    _TOP = ["name", "top", "row", "until"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # due: when the bucket's one timer rings, at the first end of a key or before it
        self.tops = handle.getValueState("tops", "keys array<string>, revisions array<long>, ids array<long>, untils array<long>, due long")

    def _held(self) -> tuple[pd.DataFrame, int]:
        *columns, due = self.tops.get() if self.tops.exists() else ([], [], [], [], 0)
        kinds = dict(zip(self._TOP, ("object", "int64", "int64", "int64"), strict=True))
        return pd.DataFrame({c: pd.Series(list(v), dtype=kinds[c]) for c, v in zip(self._TOP, columns, strict=True)}), due

    def _keep(self, held: pd.DataFrame, due: int) -> None:
        self.tops.update((*(held[c].tolist() for c in self._TOP), due))

    def _highest(self, rows: pd.DataFrame) -> pd.DataFrame:
        """A row for each key: the highest (revision, id), and the last until of all its rows."""
        last = rows.groupby("name")["until"].max()
        tops = rows.sort_values(["top", "row"]).drop_duplicates("name", keep="last")
        return tops.assign(until=tops["name"].map(last))[self._TOP]

    @staticmethod
    def _first_end(held: pd.DataFrame) -> int:
        ends = held["until"][held["until"] > 0]
        return 0 if ends.empty else int(ends.min())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news = [self._highest(part[part["whole"].astype(bool)]) for part in rows]
        news = self._highest(pd.concat(news)) if news else pd.DataFrame()
        if news.empty:
            return
        held, due = self._held()
        after = self._highest(pd.concat([held, news]))
        both = after.merge(held, on="name", how="left", suffixes=("", "_held"), indicator=True)
        risen = (both["_merge"] == "left_only") | (both["top"] != both["top_held"]) | (both["row"] != both["row_held"])
        if not risen.any() and (both["until"] == both["until_held"]).all():
            return
        first = self._first_end(after)
        if first and (not due or first < due):
            if due:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            due = first
        self._keep(after, due)
        if risen.any():
            yield both.loc[risen, ["name", "top", "row"]].reset_index(drop=True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._held()
        rung, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        held = held[~((held["until"] > 0) & ((held["until"] <= rung) | (held["until"] < now)))]
        if held.empty:
            self.tops.clear()
        else:
            due = self._first_end(held)
            if due:
                self.handle.registerTimer(due)
            self._keep(held, due)
        return iter([])

    def close(self) -> None:
        pass


def rising_revisions(stream: DataFrame, keys: list[str], revision: str, key: str, at: str, horizon: str = HORIZON, buckets: int = BUCKETS) -> DataFrame:
    """keys, revision, key: a row whenever a key's highest (revision, key) rises (update mode), from state that is kept by bucket of keys.

    A batch touches the state of its own keys' buckets only; a checkpoint goes on with the number of buckets it began with. at: when a row was published; a key of which nothing was published for the horizon
    before the watermark is forgotten, so the state is as large as the keys of that time; its next row is told as its first. Rows later than the watermark are dropped,
    as are rows without revision or key. The state lies in RocksDB: state_store() sets that.
    """
    days = int(horizon.split()[0])
    shape = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in keys)
    number, own, seen = F.col(revision).cast("long"), F.col(key).cast("long"), F.col(at).cast("timestamp")
    dealt = stream.select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"), F.to_json(F.struct(*keys), _EXACT).alias("name"), F.coalesce(number, F.lit(0)).alias("top"), F.coalesce(own, F.lit(0)).alias("row"),
        F.coalesce(F.unix_millis(seen) + days * 86_400_000, F.lit(0)).alias("until"), (number.isNotNull() & own.isNotNull()).alias("whole"), seen.alias("seen"),
    ).withWatermark("seen", horizon)
    risen = dealt.groupBy("bucket").transformWithStateInPandas(LatestRevision(), outputStructType="name string, top long, row long", outputMode="Update", timeMode="EventTime")
    return risen.withColumn("name", F.from_json("name", shape, _EXACT)).select(*[F.col(f"name.`{c}`").alias(c) for c in keys], F.col("top").alias(revision), F.col("row").alias(key))


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keep_batches(rising: DataFrame, folder: str, checkpoint: str):
    """Start writing what rises, a folder for each batch; a repeated batch replaces its own."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return rising.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(store: RecordStore, documents: DataFrame, parse, checkpoint: str, once: bool = True, every: str = REFRESH):
    """Start ingesting a stream of raw documents into the store.

    A batch runs after the one before it, as one version of the store under the stream's name (its checkpoint). A batch that is
    repeated after a failure finds itself committed, or nothing of it; so each counts once.
    """

    def ingest(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            store.ingest(rows, parse, batch, writer=checkpoint)
        finally:
            rows.unpersist()

    writer = documents.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def distinct_documents(stream: DataFrame, at: str, late: str = HORIZON) -> DataFrame:
    """The first of each (source_id, url, sha256), remembered for the refresh horizon."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["source_id", "url", "sha256"])


def read_landed(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
