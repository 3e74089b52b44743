"""Receipts, dispatch, statuses and contract checks, as columns over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, sha256_id
from ..functions.vocabulary import HARD_WORKERS

#: A component of the service and what it must offer is data, not code: services are configured by their callers.
READY, DEGRADED = ("ready",), ("degraded", "unavailable", "not_configured")


def receipt_state(state: Column, within_contract: Column | None = None) -> Column:
    """UDF-24, UDF-25: the receipt's state for an extraction's; an output outside its contract fails."""
    s = F.when(state.isin("ready", "partial_success"), "complete").when(state.isin("denied", "stale"), state).otherwise("failed")
    return s if within_contract is None else F.when(within_contract, s).otherwise("failed")


def receipt_reason(state: Column, refusal: Column, within_contract: Column | None = None) -> Column:
    """UDF-25: null for what is complete, else the reason code of a refusal."""
    r = F.when(refusal.isin("unsupported_source_type", "ineligible_source", "privacy_scope_violation"), "source_ineligible").when(refusal == "dependency_unavailable", "worker_unavailable").otherwise("internal_error_redacted")
    r = F.when(receipt_state(state) != "complete", r)
    return r if within_contract is None else F.when(within_contract, r).otherwise("output_contract_violation")


def build_receipts(shards: DataFrame, extracted: DataFrame, deadline_ms: int | None = None) -> DataFrame:
    """UDF-24, AGG-12, AGG-21, STM-14, WIN-13: shards with the receipt of their extraction, joined on source_ref.

    A shard without an extraction fails; one that took longer than the deadline is timed_out. Counts of findings are
    the sizes of blocks and sections, and tables_detected. Attempts are always the first, retries included.
    """
    cols = [c for c in ("state", "reason", "blocks", "sections", "tables_detected", "artifact_id", "duration_ms") if c in extracted.columns]
    j = shards.join(extracted.select("source_ref", *cols), "source_ref", "left")
    late = F.coalesce(F.col("duration_ms") > deadline_ms, F.lit(False)) if deadline_ms is not None and "duration_ms" in cols else F.lit(False)
    state = F.when(late, "timed_out").otherwise(receipt_state(F.coalesce("state", F.lit("unavailable"))))
    reason = F.when(late, "deadline_exceeded").otherwise(receipt_reason(F.coalesce("state", F.lit("unavailable")), F.col("reason")))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return j.select(*shards.columns, state.alias("receipt_state"), reason.alias("reason_code"), F.concat("shard_id", F.lit("-attempt-1")).alias("attempt_id"), size("blocks").alias("content_blocks"), size("sections").alias("section_count"), F.coalesce("tables_detected", F.lit(0)).alias("tables_detected"), F.when(state == "complete", F.col("artifact_id")).alias("artifact_id"))


def retry_plan(receipts: DataFrame, budget: int = 1) -> DataFrame:
    """STM-15, STM-16: receipts that may run once more: failures of infrastructure within budget; denials and cancelled ones never."""
    return receipts.filter(F.col("reason_code").isin("worker_unavailable", "internal_error_redacted") & (F.col("attempts") <= budget) & ~F.col("receipt_state").isin("denied", "cancelled", "stale"))


def negotiate(plans: DataFrame, capabilities: DataFrame, hard: int = HARD_WORKERS) -> DataFrame:
    """PRED-27, WIN-23, STR-32, UDF-23: plans × one row of capabilities, with state, reason and concurrency.

    plans: required_contracts, required_workers (arrays), requested, configured, serial_allowed. capabilities (one row):
    service_state, contracts, workers, cancellation, max_concurrency.
    """
    c = capabilities.limit(1).select(*[F.col(x).alias(f"__{x}") for x in ("service_state", "contracts", "workers", "cancellation", "max_concurrency")])
    j = plans.crossJoin(F.broadcast(c))
    ready, degraded = F.col("__service_state").isin(*READY), F.col("__service_state").isin(*DEGRADED)
    reason = (
        F.when(ready & (F.size(F.array_except("required_contracts", "__contracts")) > 0), "unsupported_contract").when(ready & (F.size(F.array_except("required_workers", "__workers")) > 0), "worker_not_admitted")
        .when(ready & ~F.col("__cancellation"), "cancellation_unsupported").when(ready & (F.least("requested", "configured", "__max_concurrency") < 1), "invalid_concurrency")
        .when(degraded & ~F.col("serial_allowed"), "serial_fallback_not_permitted").when(~ready & ~degraded, "unsupported_state")
    )
    out = j.withColumn("reason", reason)
    state = F.when(F.col("reason").isNotNull(), "rejected").when(ready, "dispatch_ready").otherwise("serial_fallback")
    n = F.when(state == "dispatch_ready", F.least("requested", "configured", "__max_concurrency", F.lit(hard))).when(state == "serial_fallback", F.lit(1))
    return out.withColumns({"state": state, "concurrency": n}).drop(*[x for x in out.columns if x.startswith("__")])


def run_statuses(summaries: DataFrame, receipts: DataFrame, cancellable: bool = False) -> DataFrame:
    """UDF-28, AGG-28, STR-42: summaries with mode, controls and distinct failure reasons.

    summaries: run_id, run_state, failed, missing, stale, fallback_used, hits, misses. receipts: run_id, reason_code.
    """
    reasons = receipts.groupBy("run_id").agg(F.sort_array(F.collect_set("reason_code")).alias("reasons"))
    mode = F.when(F.col("fallback_used"), "serial_fallback").when((F.col("hits") > 0) & (F.col("misses") == 0), "cache_reuse").when(F.col("hits") > 0, "mixed_cache_parallel").otherwise("parallel")
    running = F.col("run_state").isin("planned", "submitted", "running") & F.lit(cancellable)
    controls = F.array_compact(F.array(F.when(running, "cancel_run"), F.when((F.col("failed") > 0) | (F.col("missing") > 0), "rerun_failed_shards"), F.when(F.col("stale") > 0, "clear_changed_source_cache")))
    j = summaries.join(reasons, "run_id", "left")
    return j.withColumns({"mode": mode, "controls": controls, "reasons": F.coalesce("reasons", F.array().cast("array<string>")), "label": F.initcap(F.replace("run_state", F.lit("_"), F.lit(" ")))})


def service_status(components: DataFrame, expected: list[str]) -> DataFrame:
    """UDF-29, UDF-30: one row: ready if every expected component is implemented, degraded if some are, unavailable if none; and which are missing."""
    have = components.filter("implemented").agg(F.coalesce(F.collect_set("component"), F.array().cast("array<string>")).alias("have"))
    want = F.array(*map(F.lit, expected))
    missing = F.sort_array(F.array_except(want, "have"))
    return have.select(F.when(F.size(missing) == 0, "ready").when(F.size(missing) < len(expected), "degraded").otherwise("unavailable").alias("state"), missing.alias("missing"))


def semantic_handoffs(packages: DataFrame, requested_by: str, plan_hash: Column) -> DataFrame:
    """UDF-27, STR-46: references to ready packages with their guardrails; no content is handed on."""
    key = F.concat_ws(":", "package_id", plan_hash, F.lit(requested_by))
    ready = packages.filter(F.col("package_state").isin("ready", "partial_success"))
    fixed = {"raw_content_included": False, "receipt_mutation_allowed": False, "semantic_output_canonical": False, "details_redacted": True}
    return ready.select(sha256_id("handoff-", key, 16).alias("handoff_id"), F.col("package_id").alias("artifact_ref"), F.col("package_state").alias("source_state"), F.lit("non_canonical_candidate").alias("posture"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def failure_handoffs(failures: DataFrame) -> DataFrame:
    """UDF-19, STR-45, STR-44: failures (repo, message) as blocking issues with kind, severity, route and key."""
    from ..functions.text import failure_route

    return failures.select("repo", failure_route(F.col("message")).alias("f")).select("repo", "f.*", F.concat_ws("::", "repo", "f.kind", F.lit("surface")).alias("issue_key"), F.lit(True).alias("blocking"))


def contract_sets(documents: DataFrame, prefixes: dict[str, str], version: int = 1) -> DataFrame:
    """UDF-34: a row a prefix: how many documents (file, kind, version) it has, and whether there is one and all fit."""
    prefix = F.coalesce(*[F.when(F.startswith("file", F.lit(p)), F.lit(p)) for p in sorted(prefixes, key=len, reverse=True)])
    want = F.coalesce(*[F.when(F.col("prefix") == p, F.lit(k)) for p, k in prefixes.items()])
    got = documents.withColumn("prefix", prefix).filter("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n"), F.bool_and((F.col("kind") == want) & (F.col("version") == version)).alias("fits"))
    rows = F.explode(F.array(*map(F.lit, prefixes))).alias("prefix")
    every = documents.sparkSession.range(1).select(rows)
    return every.join(got, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("fits", F.lit(False)).alias("fits"))


def conformance(fixtures: DataFrame, schemas: list[str]) -> DataFrame:
    """UDF-35: a row a schema: its valid and invalid fixtures (file, valid), each matched to the longest name it starts with; ok if it has both."""
    name = F.coalesce(*[F.when(F.startswith("file", F.lit(s)), F.lit(s)) for s in sorted(schemas, key=len, reverse=True)])
    got = fixtures.withColumn("schema", name).filter("schema is not null").groupBy("schema").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    every = fixtures.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, schemas))).alias("schema"))
    out = every.join(got, "schema", "left").na.fill(0)
    return out.withColumn("ok", (F.col("valid") > 0) & (F.col("invalid") > 0))


def check_crawl_policies(policies: DataFrame) -> DataFrame:
    """UDF-36: policies (mode, depth, hosts, max_files) with errors: local crawls have no hosts, linked ones need some; depth is 0 to 8 and 0 for single ones."""
    from .extraction import intake_errors

    n = F.coalesce(F.size("hosts"), F.lit(0))
    rules = [
        ("mode", F.col("mode").isin("single", "local", "linked"), "not in the enum"), ("depth", F.col("depth").between(0, 8), "out of range"), ("depth", (F.col("mode") != "single") | (F.col("depth") == 0), "must be 0 for single"),
        ("hosts", (F.col("mode") == "linked") | (n <= 0), "only for linked"), ("hosts", (F.col("mode") != "linked") | (n > 0), "needed for linked"), ("max_files", F.col("max_files") > 0, "must be positive"),
    ]
    return intake_errors(policies, rules)


def has_any_key(json: Column, keys: list[str]) -> Column:
    """STR-36: whether a JSON text has an object with one of the keys at any depth: the key, quoted, before a colon, outside of strings."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"(?!\s*:)', '""')
    return F.try_parse_json(json).isNotNull() & bare.rlike('"(?:' + "|".join(keys) + r')"\s*:')


def is_filled(value: Column) -> Column:
    """STR-37: a JSON text that is neither null nor an empty text, array or object."""
    return let(F.regexp_replace(value, r"\s+", ""), lambda v: v.isNotNull() & ~v.isin("", "null", '""', "[]", "{}"))


def round3(x: Column) -> Column:
    """STR-28: three decimals, half away from zero, decided on x * 1000."""
    return F.signum(x) * F.floor(F.abs(x) * 1000 + 0.5) / 1000
