"""Change events to debounced sessions, for batches and streams alike."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P

SCHEMA = "workspace string, path string, ts timestamp, kind string, changes int, chars int, lines int, replaced int"
# Kinds of events on disk, and the quiet times of the two modes.
SAVED = ("save", "create", "change", "delete")
QUIET = {"onSave": "2 seconds", "idle": "30 seconds"}


def change_source(spark: SparkSession, folder: str, own: str = "_kb") -> DataFrame:
    """A stream of the tracked files' change events from a folder of JSON lines (SCHEMA)."""
    return tracked(spark.readStream.schema(SCHEMA).json(folder), own)


def tracked(events: DataFrame, own: str = "_kb") -> DataFrame:
    return events.filter(P.is_tracked(F.col("path"), own))


def is_bulk_edit(changes: Column, chars: Column, lines: Column, replaced: Column) -> Column:
    """Two changes, 200 inserted characters, 8 inserted lines or 400 replaced characters, or more; none without a change."""
    return (changes >= 1) & ((changes >= 2) | (chars >= 200) | (lines >= 8) | (replaced >= 400))


def debounce(events: DataFrame, key: str, ts: str = "ts", gap: str = "2 seconds", late: str | None = None) -> DataFrame:
    """(key, started, fires, events): runs of events less than gap apart; each fires gap after its last.

    ``late`` sets a watermark, which a stream needs to bound its state.
    """
    e = events.withWatermark(ts, late) if late else events
    out = e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "events")


def triggers(events: DataFrame, mode: str, key: str = "workspace", late: str | None = None) -> DataFrame:
    """When the reports are made anew: (key, started, fires, events).

    onSave: two seconds after the last save, change on disk or bulk edit; idle: thirty
    after the last event of any kind; off: never.
    """
    if mode not in ("off", *QUIET):
        raise ValueError(f"no mode {mode!r}")
    bulk = (F.col("kind") == "edit") & is_bulk_edit(*map(F.col, ("changes", "chars", "lines", "replaced")))
    on = {"off": F.lit(False), "onSave": F.coalesce(F.col("kind").isin(*SAVED) | bulk, F.lit(False)), "idle": F.lit(True)}[mode]
    return debounce(events.filter(on), key, gap=QUIET.get(mode, QUIET["onSave"]), late=late)


def stale_transitions(events: DataFrame, key: str, ts: str, stale: Column, *ties: str) -> DataFrame:
    """Events at which a key's state goes from fresh to stale; before its first event it is fresh.

    ``stale`` is an event's state; events of one time go by ``ties``.
    """
    before = F.lag("__stale", 1, False).over(Window.partitionBy(key).orderBy(ts, *ties))
    own = events.withColumn("__stale", F.coalesce(stale, F.lit(False)))
    return own.withColumn("__before", before).filter("__stale and not __before").drop("__stale", "__before")


class Regenerator:
    """An action for foreachBatch that drops a trigger while it still runs, and can be stopped.

    ``action`` gets the trigger's batch. Batches without rows are none.
    """

    def __init__(self, spark: SparkSession, action: Callable[[DataFrame], None], tag: str = "loomgraph"):
        self.spark, self.action, self.tag = spark, action, tag
        self.busy, self.done, self.dropped = threading.Lock(), 0, 0

    def __call__(self, batch: DataFrame, batch_id: int = 0) -> None:
        if batch.isEmpty():
            return
        if not self.busy.acquire(blocking=False):
            self.dropped += 1
            return
        try:
            self.spark.sparkContext.addJobTag(self.tag)
            self.action(batch)
            self.done += 1
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
            self.busy.release()

    def cancel(self) -> None:
        """Stop the jobs of a run."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
