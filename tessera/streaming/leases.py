"""Leases and watches as streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])

_OUT = "item_id string, attempt int, state string, at long, expiry long"
_STATE = "attempt int, claimed_at long, heartbeat long, state string"


def lease_stream(events: DataFrame, timeout_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """STM-07..12: transitions of each item's lease, with event-time timers that reclaim what has run out.

    events: item_id string, kind string, at timestamp; a streaming DataFrame. A claim of an active item, a heartbeat
    that goes back and a second end change nothing. State is one small row an item; ended items keep theirs, so that
    ends stay idempotent.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt, claimed, beat, now = state.get if state.exists else (0, 0, 0, "queued")
        rows = []

        def emit(at: int) -> None:
            rows.append((key[0], attempt, now, at, max(claimed, beat) + timeout_seconds if now == "claimed" else None))

        if state.hasTimedOut:
            if now == "claimed":
                now = "reclaimed"
                emit(max(claimed, beat) + timeout_seconds)
        else:
            found = pd.concat(list(frames)).sort_values(["at", "kind"])
            for kind, at in zip(found["kind"], (found["at"].astype("int64") // 10**9 if str(found["at"].dtype).endswith("[ns]") else found["at"].map(lambda x: int(x.timestamp()))), strict=True):
                if now == "claimed" and at >= max(claimed, beat) + timeout_seconds and kind == "claim":
                    now = "reclaimed"
                    emit(max(claimed, beat) + timeout_seconds)
                if kind == "claim" and now in ("queued", "reclaimed"):
                    attempt, claimed, beat, now = attempt + 1, at, 0, "claimed"
                    emit(at)
                elif kind == "heartbeat" and now == "claimed" and at >= max(claimed, beat):
                    beat = at
                    emit(at)
                elif kind in ("complete", "fail") and now == "claimed":
                    now = "completed" if kind == "complete" else "failed"
                    emit(at)
        state.update((attempt, claimed, beat, now))
        if now == "claimed":
            due = (max(claimed, beat) + timeout_seconds) * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["item_id", "attempt", "state", "at", "expiry"]).astype({"expiry": "Int64"})

    marked = events.withWatermark("at", lateness)
    return marked.groupBy("item_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def watch_stream(changes: DataFrame, debounce: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """STM-01: flushes of a watched tree: changes (root, path, ts) without `debounce` of silence between them, their number and the set of dirty paths.

    The set is kept in the session's state and is as large as the flush: a rescan of these paths is what it is for.
    """
    grouped = changes.withWatermark("ts", lateness).groupBy(F.session_window("ts", debounce).alias("w"), "root")
    return grouped.agg(F.count("*").alias("changes"), F.sort_array(F.collect_set("path")).alias("dirty")).select("root", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes", F.size("dirty").alias("paths"), "dirty")


def enqueue_stream(items: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """STM-06: each item_id once within the lateness bound."""
    return items.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["item_id"])


def rescan_stream(files: DataFrame, table: str, checkpoint: str):
    """STM-02: a stream of seen files (path, sha256, status, scan) merged into a Parquet table, one version a batch.

    A batch is part of a scan: paths outside it stay. A row without a path says that its scan has ended; then what that scan
    has not seen becomes deleted. A batch that is run again writes the same version.
    """
    from ..operators.crawl import end_scan, merge_files

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{table}/v{number - 1}") if number else spark.createDataFrame([], "path string, sha256 string, status string, first_scan long, changed_scan long, seen_scan long")
        scan, ended = batch.agg(F.max("scan"), F.max(F.when(F.col("path").isNull(), F.col("scan")))).first()
        last = batch.filter("path is not null").groupBy("path").agg(F.max(F.struct("scan", "sha256", "status")).alias("x")).select("path", "x.sha256", "x.status")
        now = merge_files(old, last, F.lit(scan).cast("long"), whole=False)
        if ended is not None:
            now = end_scan(now, F.lit(ended).cast("long"))
        now.write.mode("overwrite").parquet(f"{table}/v{number}")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
