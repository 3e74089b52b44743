"""The work queue as an event log: items, claims, heartbeats, ends; states are derived, nothing is rewritten in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lease_expiry, sha256_id

CLAIM = ("item_id", "attempt")


def enqueue(items: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """STM-06: one row a distinct item_id with result enqueued or already_present."""
    once = items.dropDuplicates(["item_id"])
    if present is None:
        return once.withColumn("result", F.lit("enqueued"))
    known = present.select("item_id", F.lit(True).alias("__known")).distinct()
    return once.join(known, "item_id", "left").withColumn("result", F.when(F.col("__known"), "already_present").otherwise("enqueued")).drop("__known")


def number_claims(events: DataFrame) -> DataFrame:
    """STM-07, WIN-14: claim events with attempt (1 for an item's first claim) and claim_id."""
    n = F.row_number().over(Window.partitionBy("item_id").orderBy("at", "event_id"))
    claims = events.filter("kind = 'claim'").withColumn("attempt", n)
    return claims.withColumn("claim_id", sha256_id("claim-", F.concat_ws("|", F.col("item_id").cast("string"), F.col("attempt").cast("string"), "actor"), 24))


def episodes(events: DataFrame) -> DataFrame:
    """STM-07..12, WIN-12: a row a claim episode: what lies between a claim of an item and its next one.

    events: item_id, event_id, kind (claim, heartbeat, complete, fail, reclaim), actor, at (epoch seconds). The first
    of several ends counts (they are idempotent); heartbeats that go back or precede the claim are only counted as
    invalid. Derived state: completed, failed, reclaimed, active.
    """
    w = Window.partitionBy("item_id").orderBy("at", "event_id")
    seq = events.withColumn("attempt", F.count_if(F.col("kind") == "claim").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("attempt > 0")
    beat = F.col("kind") == "heartbeat"
    own = Window.partitionBy("item_id", "attempt").orderBy("at", "event_id")
    ended = F.max(F.col("kind").isin("complete", "fail", "reclaim")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    seq = seq.withColumn("live", ~F.coalesce(ended, F.lit(False)))
    first_end = lambda kind: F.min(F.when((F.col("kind") == kind) & F.col("live"), F.col("at")))
    out = seq.groupBy("item_id", "attempt").agg(
        F.min_by("actor", F.when(F.col("kind") == "claim", F.col("at"))).alias("claimant"), F.min(F.when(F.col("kind") == "claim", F.col("at"))).alias("claimed_at"), F.count_if(beat & F.col("live")).alias("heartbeats"),
        F.max(F.when(beat & F.col("live"), F.col("at"))).alias("last_heartbeat"), first_end("complete").alias("completed_at"), first_end("fail").alias("failed_at"), first_end("reclaim").alias("reclaimed_at"),
    )
    return out.withColumn("state", claim_state(F.col("completed_at"), F.col("failed_at"), F.col("reclaimed_at")))


def claim_state(completed: Column, failed: Column, reclaimed: Column) -> Column:
    """STM-12, PRED-19: completed before failed before reclaimed before active."""
    return F.when(completed.isNotNull(), "completed").when(failed.isNotNull(), "failed").when(reclaimed.isNotNull(), "reclaimed").otherwise("active")


def expired(episodes_: DataFrame, now: Column, own_timeout: Column, fallback: Column) -> DataFrame:
    """STR-25, STM-09: active episodes whose lease has run out at `now` (>=), with expiry and its source."""
    e = episodes_.filter("state = 'active'").withColumn("__x", lease_expiry(F.col("claimed_at"), F.col("last_heartbeat"), own_timeout, fallback))
    return e.withColumns({"expiry": F.col("__x.epoch"), "expiry_source": F.col("__x.source")}).drop("__x").filter(F.col("expiry") <= now)


def item_states(items: DataFrame, episodes_: DataFrame) -> DataFrame:
    """JOIN-15, STM-12: items with status by their last episode: queued, claimed, completed or failed; a reclaimed item is queued again."""
    last = episodes_.groupBy("item_id").agg(F.max("attempt").alias("attempts"), F.max_by("state", "attempt").alias("__state"))
    status = F.when(F.col("__state").isin("completed", "failed"), F.col("__state")).when(F.col("__state") == "active", "claimed").otherwise("queued")
    return items.join(last, "item_id", "left").withColumns({"status": status, "attempts": F.coalesce("attempts", F.lit(0))}).drop("__state")


def next_items(states: DataFrame, n: int = 1) -> DataFrame:
    """WIN-11: the first n queued items by id (which is a hash: not first in, first out)."""
    return states.filter("status = 'queued'").orderBy("item_id").limit(n)


def check_receipts(claims: DataFrame, receipts: DataFrame) -> DataFrame:
    """PRED-20, PRED-21, STM-10, STM-11: receipts with outcome: accepted, already_ended, or the first of the fields that disagrees.

    claims and receipts: claim_id, attempt, item_id, claimant, claimed_at; receipts also seq. Ends are idempotent a claim and attempt.
    """
    c = claims.select("claim_id", *[F.col(x).alias(f"__{x}") for x in ("attempt", "item_id", "claimant", "claimed_at")])
    j = receipts.join(c, "claim_id", "left")
    wrong = F.coalesce(F.when(F.col("__item_id").isNull(), "claim_missing"), *[F.when(~F.col(x).eqNullSafe(F.col(f"__{x}")), f"{x}_mismatch") for x in ("attempt", "item_id", "claimant", "claimed_at")])
    j = j.withColumn("wrong", wrong)
    before = F.max(F.col("wrong").isNull()).over(Window.partitionBy("claim_id", "attempt").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return j.withColumn("outcome", F.coalesce("wrong", F.when(F.coalesce(before, F.lit(False)), "already_ended"), F.lit("accepted"))).drop("wrong", "__attempt", "__item_id", "__claimant", "__claimed_at")


def totals(items: DataFrame) -> DataFrame:
    """AGG-16: items, issues and blocking ones."""
    return items.agg(F.count("*").alias("items"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"), F.coalesce(F.sum("blocking"), F.lit(0)).alias("blocking"))


def report(states: DataFrame, episodes_: DataFrame) -> DataFrame:
    """AGG-17..20: totals as rows (kind, key, n, blocking): items by status, claims (an item's last episode) and all episodes by
    state, and the evidence: completions, failures and reclaims. blocking sums the blocking issues of what is counted.

    states: item_id, status, attempts and optionally blocking, as of item_states; episodes of other items don't count.
    """
    own = F.col("blocking").cast("long") if "blocking" in states.columns else F.lit(0).cast("long")
    items = states.select("item_id", "status", "attempts", F.coalesce(own, F.lit(0)).alias("blocking"))
    totals_ = [F.count("*").alias("n"), F.sum("blocking").alias("blocking")]
    a = items.groupBy(F.lit("item").alias("kind"), F.col("status").alias("key")).agg(*totals_)
    row = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    state, all_ = F.col("state"), F.lit("all")
    ends = [F.when(state == s, row(kind, all_)) for s, kind in (("completed", "completion"), ("failed", "failure"), ("reclaimed", "reclaim"))]
    kinds = F.array_compact(F.array(row("episode", state), F.when(F.col("attempt") == F.col("attempts"), row("claim", state)), *ends))
    e = episodes_.select("item_id", "attempt", "state").join(items, "item_id").select(F.explode(kinds).alias("x"), "blocking")
    return a.unionByName(e.groupBy(F.col("x.kind").alias("kind"), F.col("x.key").alias("key")).agg(*totals_))


def schema_keys(documents: DataFrame, column: str) -> DataFrame:
    """AGG-25: the distinct keys of a JSON column's objects."""
    return documents.select(F.explode(F.json_object_keys(column)).alias("key")).distinct()


def envelope(reports: DataFrame, contract: str = "queue_export", version: int = 1) -> DataFrame:
    """UDF-32: reports (payload) wrapped with contract, version and the payload's fingerprint."""
    from ..functions.hashing import fnv1a

    return reports.withColumns({"contract": F.lit(contract), "version": F.lit(version), "fingerprint": fnv1a(F.col("payload"))})


def accept_envelopes(envelopes: DataFrame, contract: str = "queue_export", version: int = 1) -> DataFrame:
    """PRED-24..26, UDF-33: envelopes with reasons, all that are violated, and accepted where there is none."""
    from ..functions.hashing import fnv1a

    rules = ((F.col("contract") != contract, "contract_type"), (F.col("version") != version, "contract_version"), (F.col("payload").isNull(), "payload_missing"), (~F.col("fingerprint").eqNullSafe(F.col("__now")), "fingerprint_mismatch"))
    out = envelopes.withColumn("__now", fnv1a(F.col("payload")))
    return out.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))).withColumn("accepted", F.size("reasons") == 0).drop("__now")
