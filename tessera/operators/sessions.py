"""Batch forms of the watch loop and of freshness comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int, tie: str) -> DataFrame:
    """STM-01: (key, session, first, last, n): events of a key less than the gap apart are one session, numbered from 1."""
    w = Window.partitionBy(key).orderBy(at, tie)
    far = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) >= gap_seconds * 1_000_000
    started = events.withColumn("session", F.sum(F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return started.groupBy(key, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def reconciles(flushes: DataFrame, key: str, at: str, every_seconds: int, until: Column) -> DataFrame:
    """STM-01: (key, at): the full scans of a watch: each time `every_seconds` have gone by since a key's last scan, a flush or one of these.

    flushes: key and `at`, the second of a flush. A scan that falls on the next flush is left to that flush; behind the
    last flush scans go on until `until`, that second included.
    """
    after = F.lead(F.col(at)).over(Window.partitionBy(key).orderBy(at))
    spans = flushes.select(key, F.col(at).cast("long").alias("__at"), F.coalesce(after - 1, until).cast("long").alias("__end"))
    due = F.col("__at") + every_seconds
    return spans.filter(due <= F.col("__end")).select(key, F.explode(F.sequence(due, F.col("__end"), F.lit(every_seconds).cast("long"))).alias("at"))


def parity(assembled: Column, newest_source: Column) -> Column:
    """STM-21, AGG-27: supports if the assembled copy is as new as its newest source, refutes if older, unavailable without either."""
    return F.when(assembled.isNull() | newest_source.isNull(), "unavailable").when(assembled >= newest_source, "supports").otherwise("refutes")
