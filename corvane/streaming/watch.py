"""Changes of files as a stream: events are filtered, gathered until nothing comes for a while, and acted on."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import delta
from ..session import scratch
from ..sources.files import EXCLUDED, excluded, listing

log = logging.getLogger(__name__)

#: How long nothing must come, how late events may be, and what is no change worth acting on.
QUIET, LATE = "2 seconds", "10 seconds"
IGNORED = tuple(EXCLUDED)
EVENTS = "path string, kind string, is_directory boolean, ts timestamp"


def relevant(events: DataFrame, globs: tuple[str, ...] = IGNORED) -> DataFrame:
    """Changes of files inside the root: absolute paths and paths that climb out of it are not."""
    path = F.col("path")
    outside = F.startswith(path, F.lit("/")) | path.rlike(r"(^|/)\.\.(/|$)")
    return events.filter(~F.coalesce("is_directory", F.lit(False)) & path.isNotNull() & ~outside & ~excluded(path, globs))


def debounced(events: DataFrame, key: str | None = None, gap: str = QUIET, late: str = LATE) -> DataFrame:
    """A row per burst, of each ``key`` if there is one: events at most ``gap`` apart; on a stream it comes once the watermark has
    passed the gap. A burst is a few numbers however many events it has; tasks count their own before these are put together."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    # a stream's sessions need a key beside the window; without one, all events share the same
    events = events if key else events.withColumn("_all", F.lit(0))
    keys = [key] if key else []
    g = events.groupBy(key or "_all", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return g.select(*keys, "first", "last", F.col("w.end").alias("settled"), "events")


def events_of(spark: SparkSession, folder: str, form: str = "json") -> DataFrame:
    return spark.readStream.schema(EVENTS).format(form).load(folder)


class Watcher:
    """One query per root over a feed of events, which acts when a burst of them has settled; its micro-batches never
    overlap, and what comes meanwhile waits for the next."""

    running: dict[str, Watcher] = {}

    def __init__(self, root: str, source: DataFrame, action: Callable[[], object], checkpoint: str):
        self.root, self.source, self.action, self.checkpoint, self.query = root, source, action, checkpoint, None

    def _act(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            self.action()
        except Exception:  # a failed update must not end the watch
            log.exception("the update after batch %d of %s failed", number, self.root)

    def start(self, trigger: str | None = None) -> Watcher:
        if self.root in Watcher.running and Watcher.running[self.root].is_running:
            return Watcher.running[self.root]
        writer = debounced(relevant(self.source)).writeStream.outputMode("append").foreachBatch(self._act).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
        Watcher.running[self.root] = self
        return self

    @property
    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
        Watcher.running.pop(self.root, None)


class TreeWatcher:
    """Looks at a tree every so often and acts once changes have settled.

    A look lists the tree and compares it with the last look; as long as two looks differ, changes are still coming. Only
    files that ``relevant`` lets through count. The looks are micro-batches of one query, so they never overlap.
    """

    def __init__(self, spark: SparkSession, root: str, action: Callable[[], object], state: str):
        self.spark, self.root, self.action, self.state = spark, root, action, state.rstrip("/")
        self.query, self.pending, self.changes, self._seen, self._number = None, False, 0, None, 0

    def events(self, now: DataFrame) -> DataFrame:
        """What changed between the last look and ``now``, as events."""
        kinds = F.create_map(*(F.lit(x) for x in ("add", "created", "modify", "modified", "remove", "deleted")))
        plan = delta.plan(now, self._seen).filter("action <> 'keep'")
        return relevant(plan.select("path", kinds[F.col("action")].alias("kind"), F.lit(False).alias("is_directory"), F.timestamp_seconds("mtime").alias("ts")))

    def look(self) -> None:
        with scratch(self.spark):
            now = listing(self.spark, self.root).select("path", "mtime")
            at = f"{self.state}/look-{self._number % 2}"
            now.write.mode("overwrite").parquet(at)
        now = self.spark.read.schema("path string, mtime double").parquet(at)
        self._number += 1
        changed = 0 if self._seen is None else self.events(now).count()
        self._seen = now
        if changed:
            self.pending, self.changes = True, self.changes + changed
        elif self.pending:
            self.pending = False
            try:
                self.action()
            except Exception:  # a failed update must not end the watch
                log.exception("the update of %s failed", self.root)

    def start(self, every: str = QUIET) -> TreeWatcher:
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        self.query = clock.writeStream.foreachBatch(lambda batch, number: self.look()).option("checkpointLocation", f"{self.state}/clock").trigger(processingTime=every).start()
        return self

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()


def write_debounced(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """The bursts of a stream as a table in memory; for tests and small feeds."""
    return debounced(relevant(events)).writeStream.outputMode("append").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
