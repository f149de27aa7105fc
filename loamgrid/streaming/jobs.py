"""Incremental versions of counts, usage, deduplication, sessions and ingest on Structured Streaming."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loamgrid.plans.durable import checkpoint_dir, durable
from loamgrid.sources.store import RecordStore, changed, fingerprints


#: The store of keyed state that keeps its data on disk.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder or file, with naive times as timestamps; all new files are a batch, or so many, oldest first."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    files = spark.readStream.schema(schema).option("pathGlobFilter", name)
    raw = (files.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else files).parquet(folder)
    times = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else raw


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has to say about all data there is now: it runs once to the end into a table, which is read back.

    State and output are kept in the shared checkpoint folder. In update mode the last row a key wins elsewhere.
    """
    spark = stream.sparkSession
    base = posixpath.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    out = posixpath.join(base, "out")
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(posixpath.join(out, f"batch={number}"))

    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # state with timers and lists needs it; a query keeps what it was started with
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", posixpath.join(base, "state")).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, provider)
    query.awaitTermination()
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("__batch", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(out)


def period_counts(events: DataFrame, ts: str, delay: str = "2 days", width: str = "1 day") -> DataFrame:
    """Counts per tumbling window; rows behind the watermark that the batch before began with are dropped, and counted in the query's progress."""
    w = events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def usage_by_day(events: DataFrame, owner: str, ts: str, value: str) -> DataFrame:
    w = events.withWatermark(ts, "2 days").groupBy(owner, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("turns"), F.sum(value).alias("spent"))
    return w.select(owner, F.col("w.start").alias("start"), "turns", "spent")


def dedupe_calls(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Each call id once, as long as its repeats come within the watermark."""
    return events.withWatermark(ts, "2 days").dropDuplicatesWithinWatermark([key])


def session_ring(turns: DataFrame, thread: str, order: str, keep: int, idle: timedelta | None = None) -> DataFrame:
    """(thread, turn list, seen): the last ``keep`` turns of each thread in order, without repeats, after each batch.

    State is a list of at most ``keep`` turns and a count. Rows come in pieces and in any order; a piece is all that a
    task holds. A thread that is quiet for ``idle`` is forgotten.
    """
    kind, ttl = turns.schema[thread].dataType.simpleString(), None if idle is None else int(idle.total_seconds() * 1000)

    class Ring(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.ring = handle.getListState("ring", "turn long", ttl)
            self.seen = handle.getValueState("seen", "n long", ttl)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            ring = {r[0] for r in self.ring.get()}
            seen = self.seen.get()[0] if self.seen.exists() else 0
            for part in rows:
                seen += len(part)
                ring = set(sorted(ring | set(part[order].dropna().astype("int64").tolist()))[-keep:])
            last = sorted(ring)
            self.ring.put([(t,) for t in last])
            self.seen.update((seen,))
            yield pd.DataFrame({thread: [key[0]], "turns": [last], "seen": [seen]})

    return turns.select(thread, order).groupBy(thread).transformWithStateInPandas(Ring(), f"`{thread}` {kind}, turns array<long>, seen long", "Update", "ProcessingTime" if ttl else "None")


def repeat_detector(calls: DataFrame, thread: str, ts: str, order: str, digest: str, change: str, delay: str = "2 days") -> DataFrame:
    """(thread, order, repeated): whether an equal call was made since the thread's last change.

    Calls count in the order of their time, then ``order``, whatever the batch that brings them: each waits in the state
    until the watermark has passed its time, when a timer takes the waiting ones up to there, one after the other. State is
    those and the digests since the last change, so it is bounded by ``delay`` and by a thread's own
    calls between changes; calls that come later than ``delay`` are dropped. Calls after the last watermark still wait.
    """
    kind = calls.schema[thread].dataType.simpleString()

    class Repeats(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "ms long, place long, digest string, change boolean")
            self.seen = handle.getListState("seen", "digest string")
            self.due = handle.getValueState("due", "ms long")

        def _wake(self, waiting: list[tuple]) -> None:
            """One timer a thread, at the earliest waiting call."""
            first, due = min(w[0] for w in waiting), self.due.get()[0] if self.due.exists() else None
            if due is None or first < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(first)
                self.due.update((first,))

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            new = []
            for part in rows:
                new += list(zip(part["ms"].tolist(), part[order].tolist(), part[digest].tolist(), [bool(c) for c in part[change]], strict=True))
            if new:
                self.waiting.appendList(new)
                self._wake(new)
            return iter(())

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
            until = timerValues.getCurrentWatermarkInMs()
            waiting = sorted(tuple(w) for w in self.waiting.get())
            ready, rest = [w for w in waiting if w[0] <= until], [w for w in waiting if w[0] > until]
            seen, out = {r[0] for r in self.seen.get()}, []
            for _, place, what, changed in ready:
                if changed:
                    seen = set()
                out.append((key[0], place, what in seen))
                seen.add(what)
            for state, kept in ((self.seen, [(s,) for s in sorted(seen, key=str)]), (self.waiting, rest)):
                state.put(kept) if kept else state.clear()
            self.due.clear()
            if rest:
                self._wake(rest)
            yield pd.DataFrame(out, columns=[thread, order, "repeated"])

    timed = calls.select(thread, ts, order, digest, change, F.unix_millis(F.col(ts)).alias("ms")).withWatermark(ts, delay)
    return timed.groupBy(thread).transformWithStateInPandas(Repeats(), f"`{thread}` {kind}, `{order}` long, repeated boolean", "Append", "EventTime")


def trace_summary(events: DataFrame, thread: str, kind: str) -> DataFrame:
    """Counts of each kind per thread, updated as events land."""
    kinds = ("error", "click", "view", "purchase", "signup")
    return events.groupBy(thread).agg(*[F.sum((F.col(kind) == k).cast("long")).alias(f"n_{k}") for k in kinds])


def ingest_changed(records: DataFrame, folder: str, parent: str, table: str = "records", alive: DataFrame | None = None, most_layers: int = 8) -> DataFrame:
    """A file stream into a table of a ``RecordStore``: parents whose rows are unchanged are skipped, others replace all their rows.

    A batch has all rows of the parents it brings. It becomes one layer, noted under its number, so a batch that is
    done twice changes nothing; the stream's progress lies in the store too, so a later call goes on after a restart.
    With ``alive``, a listing of the parents that still exist, the others are removed at the end. Rows without a
    parent aren't stored. Layers are merged past ``most_layers``, and what no recent version names is deleted.
    """
    store = RecordStore(records.sparkSession, folder, parent, most_layers)

    def step(batch: DataFrame, number: int) -> None:
        rows = durable(batch)
        store.replace({table: rows}, changed(store, fingerprints({table: rows}, parent)), ("stream", number))

    query = records.writeStream.foreachBatch(step).option("checkpointLocation", posixpath.join(folder, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    if alive is not None:
        store.remove_orphans(alive)
    store.vacuum()
    return store.read(table)
