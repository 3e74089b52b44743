"""Runs: a plan of shards, receipts reconciled with it, the cache of receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256_id
from ..functions.vocabulary import CACHE_TTL_DAYS, DEFAULT_WORKERS, HARD_WORKERS, MAX_SHARDS


def plan_shards(sources: DataFrame, run: str = "run_id", most: int = MAX_SHARDS) -> DataFrame:
    """UDF-22, WIN-05, WIN-19, STR-13: sources (run, seq, source_ref, digest) with ordinal, shard_id and shards, and without runs beyond `most`.

    Ordinals follow seq within a run, runs are partitions of their own. A run of more sources than `most` has none.
    """
    by = Window.partitionBy(run)
    out = sources.withColumns({"ordinal": F.row_number().over(by.orderBy("seq", "source_ref")) - 1, "shards": F.count("*").over(by)})
    key = F.concat_ws(":", F.col(run).cast("string"), F.col("ordinal").cast("string"), "source_ref", "digest")
    shard_id = F.format_string("%s-shard-%04d-%s", F.col(run).cast("string"), F.col("ordinal"), F.substring(F.sha2(key, 256), 1, 12))
    return out.filter(F.col("shards") <= most).withColumn("shard_id", shard_id)


def concurrency(requested: Column, configured: int = DEFAULT_WORKERS, hard: int = HARD_WORKERS) -> Column:
    """STR-32, PRED-27: at least 1, at most the least of the limits."""
    return F.greatest(F.lit(1), F.least(requested, F.lit(configured), F.lit(hard)))


def judge_receipts(shards: DataFrame, receipts: DataFrame, valid: Column | None = None) -> DataFrame:
    """JOIN-08, WIN-09, PRED-20, STM-13: receipts with reason, null where accepted, and shard_run, the run that planned the shard.

    shards: run_id, shard_id, digest. receipts: run_id (of the run they say), shard_id, seq, state, before, after. The
    first failing rule decides: schema_invalid, run_id_mismatch, shard_id_mismatch, duplicate_shard (an accepted one
    came before), source_fingerprint_mismatch. A run that no plan has is a mismatch whatever the shard; so is one that is
    not the shard's. A stale receipt must differ from the shard's digest, any other agree.
    """
    known = shards.select(F.col("run_id").alias("__run"), F.col("shard_id").alias("__shard"), F.col("digest").alias("__digest"))
    runs = shards.select(F.col("run_id").alias("__plan")).distinct()
    j = receipts.join(runs, F.col("run_id") == F.col("__plan"), "left").join(known, F.col("shard_id") == F.col("__shard"), "left")
    agree = (F.col("before") == F.col("__digest")) & (F.col("after") == F.col("__digest"))
    fits = F.coalesce(F.when(F.col("state") == "stale", ~agree).otherwise(agree), F.lit(False))
    early = F.when(~F.coalesce(valid, F.lit(True)) if valid is not None else F.lit(False), "schema_invalid").when(F.col("__plan").isNull(), "run_id_mismatch").when(F.col("__shard").isNull(), "shard_id_mismatch").when(~F.col("run_id").eqNullSafe(F.col("__run")), "run_id_mismatch")
    j = j.withColumn("__early", early).withColumn("__fits", F.col("__early").isNull() & fits)
    seen = F.coalesce(F.max("__fits").over(Window.partitionBy("shard_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    reason = F.coalesce(F.col("__early"), F.when(seen, "duplicate_shard").when(~F.col("__fits"), "source_fingerprint_mismatch"))
    return j.withColumn("reason", reason).withColumnRenamed("__run", "shard_run").drop("__plan", "__shard", "__digest", "__early", "__fits")


def missing_shards(shards: DataFrame, judged: DataFrame) -> DataFrame:
    """JOIN-09."""
    return shards.join(judged.filter("reason is null").select("shard_id"), "shard_id", "left_anti")


def run_state(expected: Column, completed: Column, failed: Column, stale: Column, cancelled: Column, missing: Column, rejected: Column) -> Column:
    """AGG-09: the state of a run from its counts, the first that holds."""
    clean = (failed + stale + cancelled + missing + rejected) == 0
    return (
        F.when(expected == 0, "failed").when((completed == expected) & clean, "ready").when(completed > 0, "partial_success")
        .when((stale > 0) & (failed + cancelled + missing == 0), "stale").when((cancelled > 0) & (failed + stale + missing == 0), "cancelled").otherwise("failed")
    )


def reconcile(shards: DataFrame, judged: DataFrame) -> DataFrame:
    """AGG-08..11, AGG-24: a row a run: counts by state, run_state, started_at, completed_at, and duration_ms (the sum of shards' own)."""
    expected = shards.groupBy("run_id").agg(F.count("*").alias("expected"))
    ok = F.col("reason").isNull()
    n = lambda c, name: F.count_if(c).alias(name)
    got = judged.withColumn("run_id", F.coalesce("shard_run", "run_id"))
    per = got.groupBy("run_id").agg(
        n(ok & (F.col("state") == "complete"), "completed"), n(ok & F.col("state").isin("failed", "denied", "timed_out"), "failed"), n(ok & (F.col("state") == "stale"), "stale"),
        n(ok & (F.col("state") == "cancelled"), "cancelled"), n(~ok, "rejected"), F.count_distinct(F.when(ok, F.col("shard_id"))).alias("accepted"),
        F.min(F.when(ok, F.col("started_at"))).alias("started_at"), F.max(F.when(ok, F.col("completed_at"))).alias("completed_at"), F.coalesce(F.sum(F.when(ok, F.col("duration_ms"))), F.lit(0)).alias("duration_ms"),
    )
    out = expected.join(per, "run_id", "left").na.fill(0, ["completed", "failed", "stale", "cancelled", "rejected", "accepted", "duration_ms"])
    out = out.withColumn("missing", F.col("expected") - F.col("accepted"))
    return out.withColumn("run_state", run_state(*[F.col(c) for c in ("expected", "completed", "failed", "stale", "cancelled", "missing", "rejected")])).drop("accepted")


def cache_lookup(shards: DataFrame, cache: DataFrame, now: Column, identity: tuple[str, ...] = ("digest", "worker")) -> DataFrame:
    """JOIN-13, STR-15, STR-27, UDF-26: shards with hit and receipt_hash: a live record equal in key and identity.

    A record is live if ready, not invalidated, and younger than its days at `now`. Of several the newest counts, of those
    the one with the greatest hash.
    """
    live = cache.filter((F.col("cache_state") == "ready") & F.col("invalidated_at").isNull() & (F.col("created_at") + F.make_interval(days=F.lit(CACHE_TTL_DAYS)) > now))
    best = live.groupBy(*identity).agg(F.max(F.struct("created_at", "receipt_hash"))["receipt_hash"].alias("receipt_hash"))
    return shards.join(best, list(identity), "left").withColumn("hit", F.col("receipt_hash").isNotNull())


def cache_outcome(looked_up: DataFrame) -> DataFrame:
    """AGG-23: hits and misses."""
    return looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """JOIN-12, STM-18: digests of sources (source_ref, digest) that differ in the next plan."""
    b, a = before.select("source_ref", F.col("digest").alias("old")), after.select("source_ref", F.col("digest").alias("new"))
    return b.join(a, "source_ref").filter("old <> new").select("source_ref", "old", "new")


def invalidate(cache: DataFrame, changed: DataFrame, at: Column) -> DataFrame:
    """STM-18: cache with the live records of changed digests flipped to invalidated."""
    gone = changed.select(F.col("old").alias("digest"), F.lit(True).alias("__gone")).distinct()
    j = cache.join(gone, "digest", "left")
    flip = F.coalesce("__gone", F.lit(False)) & F.col("invalidated_at").isNull()
    return j.withColumns({"cache_state": F.when(flip, "invalidated").otherwise(F.col("cache_state")), "invalidated_at": F.when(flip, at).otherwise(F.col("invalidated_at"))}).drop("__gone")


def run_package(shards: DataFrame, receipts: DataFrame, chunks: DataFrame) -> DataFrame:
    """JOIN-14, WIN-08, WIN-15, STR-11, AGG-28, AGG-29: chunks of a run's shards in shard, then local order, numbered throughout a run.

    The last receipt of a shard counts; shards without a complete one give no chunk. receipts: shard_id, seq, state.
    chunks: shard_id, local, kind, text.
    """
    last = receipts.groupBy("shard_id").agg(F.max_by("state", "seq").alias("state")).filter("state = 'complete'")
    j = shards.join(last, "shard_id").join(chunks, "shard_id")
    out = j.withColumn("ordinal", F.row_number().over(Window.partitionBy("run_id").orderBy("ordinal", "local")) - 1)
    key = F.concat_ws(":", F.col("run_id").cast("string"), "source_ref", F.col("ordinal").cast("string"), F.col("local").cast("string"))
    return out.withColumn("chunk_id", sha256_id("chunk-", key, 12))
