"""Claims: observations of several systems weighed into one explained decision a group.

A group is (repository, revision, target, class); a null revision is a group of its own. All comparisons within a
group are window aggregates over counts, so no observation is ever paired with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, lookup
from ..functions.vocabulary import AUTHORITY, DEFAULT_WEIGHTS, FRESHNESS, HEALTH, OTHER_HEALTH, WEIGHTS

GROUP = ("repository", "revision", "target", "claim_class")


def authority(subsystem: Column, claim_class: Column) -> Column:
    """JOIN-20: the score of (subsystem, class), else of (subsystem, any), else 0. The table is a map literal."""
    table = {f"{s}|{c}": v for s, classes in AUTHORITY.items() for c, v in classes.items()}
    exact = lookup(F.concat_ws("|", subsystem, claim_class), table)
    return F.coalesce(exact, lookup(F.concat_ws("|", subsystem, F.lit("*")), table), F.lit(0.0))


def weight(claim_class: Column, k: int) -> Column:
    """JOIN-21: one of a class's weights, or the default's."""
    return lookup(claim_class, {c: float(w[k]) for c, w in WEIGHTS.items()}, float(DEFAULT_WEIGHTS[k]))


def required_authority(claim_class: Column) -> Column:
    return lookup(claim_class, {c: w[5] for c, w in WEIGHTS.items() if w[5]})


def evidence_strength(strength: Column, evidence: Column | None = None) -> Column:
    """AGG-22: the stated strength, else the greatest of the evidence's, at least 0.5; within 0 and 1."""
    inner = F.coalesce(F.array_max(evidence), F.lit(0.5)) if evidence is not None else F.lit(0.5)
    return clamp(F.coalesce(strength, F.greatest(F.lit(0.5), inner)))


def score_observations(obs: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """JOIN-19, AGG-03, STR-30, STR-31: obs with authority, agreement, contradiction and milli (the rounded score in thousandths).

    Agreement counts peers of other subsystems: those of the own polarity less those opposed, over both. What opposes:
    the other side for a supporter or refuter, both sides for the rest. Contradiction is the greatest authority on the
    other side, own subsystem included.
    """
    g, gs = Window.partitionBy(*group), Window.partitionBy(*group, "subsystem")
    out = obs.withColumn("authority", authority(F.col("subsystem"), F.col("claim_class")))
    pol = F.col("polarity")

    def others(p: Column) -> Column:
        return F.count_if(p).over(g) - F.count_if(p).over(gs)

    peers = {p: others(pol == p) for p in ("supports", "refutes", "unavailable", "not_run")}
    same = F.coalesce(*[F.when(pol == p, n) for p, n in peers.items()])
    opposed = F.when(pol == "supports", peers["refutes"]).when(pol == "refutes", peers["supports"]).otherwise(peers["supports"] + peers["refutes"])
    out = out.withColumns({"__same": same, "__opposed": opposed})
    both = F.col("__same") + F.col("__opposed")
    agreement = F.when(both > 0, (F.col("__same") - F.col("__opposed")) / both).otherwise(0.0)
    against = lambda p: F.coalesce(F.max(F.when(pol == p, F.col("authority"))).over(g), F.lit(0.0))
    out = out.withColumns({"agreement": agreement, "__no": against("refutes"), "__yes": against("supports")})
    out = out.withColumn("contradiction", F.when(pol == "supports", F.col("__no")).when(pol == "refutes", F.col("__yes")).otherwise(0.0))
    signals = ("authority", "strength", "__fresh", "agreement")
    out = out.withColumns({"__fresh": lookup(F.col("freshness"), FRESHNESS, 0.5), "__health": lookup(F.col("health"), HEALTH, OTHER_HEALTH)})
    total = sum((weight(F.col("claim_class"), k) * F.col(s) for k, s in enumerate(signals)), F.lit(0.0)) - weight(F.col("claim_class"), 4) * F.col("contradiction")
    milli = F.greatest(F.lit(0.0), total) * F.col("__health") * 1000
    return out.withColumn("milli", F.round(milli).cast("long")).drop("__same", "__opposed", "__no", "__yes", "__fresh", "__health")


def decide(scored: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """AGG-01..07, PRED-17: a row a group: support and refute (thousandths), the greatest authority, evidence and freshness, gates,
    disposition, band, mismatch (null where there is none) and rationale, freshness posture, systems and ids.

    Evidence that is stale and has no fresh support beside it makes the posture stale, whatever else is fresh.
    """
    pol, fresh, sub, cls = F.col("polarity"), F.col("freshness"), F.col("subsystem"), F.col("claim_class")
    need = required_authority(cls)
    yes, no = pol == "supports", pol == "refutes"
    any_ = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    facts = scored.groupBy(*group).agg(
        F.sum(F.when(yes, F.col("milli")).otherwise(0)).alias("support"), F.sum(F.when(no, F.col("milli")).otherwise(0)).alias("refute"), F.count("*").alias("n"),
        *[F.greatest(F.lit(0.0), F.max(c)).alias(name) for c, name in ((F.col("authority"), "authority_score"), (F.col("strength"), "evidence_score"), (lookup(fresh, FRESHNESS, 0.5), "freshness_score"))],
        any_(sub == need, "required_present"), any_((sub == need) & yes, "required_supports"), F.bool_and(pol.isin("unavailable", "not_run")).alias("all_unavailable"),
        any_((cls == "compile_validity") & (sub == "compiler") & no, "compiler_refutes"), any_((cls == "doc_parity") & (sub == "governance") & no, "parity_refutes"),
        any_((cls == "artifact_extraction_ready") & (sub == "artifacts") & (no | (pol == "unavailable")), "artifact_denied"),
        any_(yes & (fresh == "stale"), "stale_yes"), any_(yes & (fresh == "fresh"), "fresh_yes"),
        any_(fresh == "fresh", "any_fresh"), any_(fresh == "historical", "any_historical"), any_(fresh == "stale", "any_stale"),
        any_(yes & (F.col("authority") >= 0.9) & (F.col("milli") > 0), "strong_yes"), any_(no & (F.col("authority") >= 0.9) & (F.col("milli") > 0), "strong_no"),
        F.array_join(F.sort_array(F.collect_set("subsystem")), ",").alias("systems"), F.sort_array(F.collect_list("observation_id")).alias("observation_ids"),
    )
    target = F.trim(F.coalesce(F.col("target"), F.lit("")))
    fail = F.col("compiler_refutes") | F.col("parity_refutes") | F.col("artifact_denied")
    stale_only = F.col("stale_yes") & ~F.col("fresh_yes")
    gate = lambda name, status: F.concat(F.lit(f"{name}:"), status)
    when = lambda c, name, status: F.when(c, gate(name, F.lit(status)))
    gates = F.array_compact(
        F.array(
            gate("identity_binding", F.when(target == "", "gate_unverifiable").otherwise("gate_pass")),
            F.when(need.isNotNull(), gate("required_authority_presence", F.when(F.col("required_present"), "gate_pass").otherwise("gate_unverifiable"))),
            when(F.col("all_unavailable"), "all_sources_unavailable", "gate_unverifiable"),
            when(F.col("compiler_refutes"), "compiler_truth_refutation", "gate_fail"),
            when(F.col("parity_refutes"), "doc_parity_refutation", "gate_fail"),
            when(F.col("artifact_denied"), "artifact_denial", "gate_fail"),
            when(stale_only, "stale_support_only", "gate_conflict"),
        )
    )
    s, r = F.col("support"), F.col("refute")
    number = lambda c: F.format_string("%.3f", c / 1000)
    rung = lambda d, b, m, *why: F.struct(F.lit(d).alias("disposition"), F.lit(b).alias("band"), (m if isinstance(m, Column) else F.lit(m).cast("string")).alias("mismatch"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in why]).alias("rationale"))
    failed = F.when(cls == "compile_validity", "compile_vs_parse_disagreement").when(cls == "artifact_extraction_ready", "lane_unavailability_conflict").otherwise("rule_conflict")
    stale_why = "supporting evidence is stale and no fresh support is present"
    both = ("support (", number(s), ") and refutation (", number(r), ") both exceed dispute threshold")
    ladder = (
        F.when(target == "", rung("unverifiable", "none", "identity_binding_conflict", "identity hard gate could not bind the claim target"))
        .when(F.col("all_unavailable"), rung("missing_required_evidence", "none", "lane_unavailability_conflict", "no runnable subsystem produced claim evidence"))
        .when(fail & (cls == "doc_parity"), rung("policy_mismatch", "high", "doc_vs_code_mismatch", "hard gate failed before weighting"))
        .when(fail, rung("contradicted", "high", failed, "hard gate failed before weighting"))
        .when(stale_only & (cls == "artifact_extraction_ready"), rung("residual_stale_artifact", "medium", "artifact_vs_repo_staleness", stale_why))
        .when(stale_only, rung("stale", "medium", "freshness_conflict", stale_why))
        .when((s > 0) & need.isNotNull() & ~F.col("required_supports"), rung("operator_review_required", "low", "missing_in_verifier", "support exists, but the claim-critical authority is missing"))
        .when((s > 350) & (r > 350) & F.col("strong_yes") & F.col("strong_no"), rung("authority_conflict", "medium", "rule_conflict", *both))
        .when((s > 350) & (r > 350), rung("disputed", "medium", "rule_conflict", *both))
        .when((r >= 550) & (r > s), rung("contradicted", "high", "rule_conflict", "refutation score ", number(r), " exceeds support ", number(s)))
        .when(s >= 780, rung("confirmed", "high", None, "weighted support ", number(s), " confirms the claim"))
        .when(s >= 600, rung("strong_support", "medium_high", None, "weighted support ", number(s), " strongly supports the claim"))
        .when(s >= 420, rung("moderate_support", "medium", None, "weighted support ", number(s), " moderately supports the claim"))
        .when(s > 0, rung("operator_review_required", "low", "coverage_shortfall", "weighted support ", number(s), " is below disposition threshold"))
        .otherwise(rung("coverage_gap", "none", "coverage_shortfall", "no supporting evidence reached the scoring threshold"))
    )
    posture = F.when(F.col("__rung.disposition").isin("stale", "residual_stale_artifact"), "stale").when(F.col("any_fresh"), "fresh").when(F.col("any_historical"), "historical").when(F.col("any_stale"), "stale").otherwise("unknown")
    out = facts.withColumns({"gates": F.array_join(gates, ","), "__rung": ladder}).withColumn("freshness_posture", posture)
    return out.select(*group, "n", "support", "refute", "authority_score", "evidence_score", "freshness_score", "gates", "__rung.*", "freshness_posture", "systems", "observation_ids")


def file_observations(files: DataFrame) -> DataFrame:
    """UDF-20, SRC-15: files (repository, revision, path, status, sha256, is_binary) as one to five claims each."""
    alive = F.col("status") != "deleted"
    claim = lambda c, p, s: F.struct(F.lit(c).alias("claim_class"), F.lit(p).alias("polarity"), F.lit(s).alias("strength"))
    claims = F.array_compact(
        F.array(
            F.when(alive, claim("file_presence", "supports", 0.9)).otherwise(claim("file_presence", "refutes", 0.9)),
            F.when(~alive, claim("file_deleted", "supports", 0.9)),
            F.when(alive & F.col("sha256").isNotNull(), claim("file_hash", "supports", 0.95)),
            F.when(F.col("status") == "parsed", claim("parse_success", "supports", 0.85)),
            F.when(F.col("status") == "parse_error", claim("parse_success", "refutes", 0.85)),
        )
    )
    exploded = files.select("repository", "revision", F.concat(F.lit("file:"), "path").alias("target"), F.explode(claims).alias("c"))
    return exploded.select("repository", "revision", "target", "c.*", F.lit("crawler").alias("subsystem"))


def diagnostic_observations(diagnostics: DataFrame) -> DataFrame:
    """UDF-21, STR-23: parse diagnostics as refutations of parse_success."""
    from ..functions.text import is_parse_code

    return diagnostics.filter(is_parse_code(F.col("code"))).select("repository", "revision", F.concat(F.lit("file:"), "path").alias("target"), F.lit("parse_success").alias("claim_class"), F.lit("refutes").alias("polarity"), F.lit(0.9).alias("strength"), F.lit("crawler").alias("subsystem"))


def artifact_observations(results: DataFrame) -> DataFrame:
    """SRC-16: an extraction result as two claims: that the artifact is ready, and that it was denied."""
    ready = F.when(F.col("state").isin("ready", "partial_success"), "supports").when(F.col("state").isin("denied", "unavailable", "stale"), "refutes").otherwise("unavailable")
    denied = F.when(F.col("state") == "denied", "supports").otherwise("refutes")
    strength = F.when(F.col("state") == "partial_success", 0.78).otherwise(0.92)
    two = F.array(F.struct(F.lit("artifact_extraction_ready").alias("claim_class"), ready.alias("polarity"), strength.alias("strength")), F.struct(F.lit("artifact_extraction_denied").alias("claim_class"), denied.alias("polarity"), F.lit(0.92).alias("strength")))
    return results.select(F.concat(F.lit("source:"), "source_ref").alias("repository"), F.col("source_hash").alias("revision"), F.concat(F.lit("artifact:"), "artifact_id").alias("target"), F.col("state").alias("health"), F.explode(two).alias("c")).select("repository", "revision", "target", "health", "c.*", F.lit("artifacts").alias("subsystem"))


def find_observations(obs: DataFrame, repository=None, target=None, claim_class=None, subsystem=None, since=None) -> DataFrame:
    """PRED-12: those that meet every given condition, in a fixed order."""
    for name, value in (("repository", repository), ("target", target), ("claim_class", claim_class), ("subsystem", subsystem)):
        if value is not None:
            obs = obs.filter(F.col(name) == value)
    if since is not None:
        obs = obs.filter(F.col("observed_at") >= since)
    return obs.orderBy("repository", "target", "claim_class", "observed_at", "observation_id")


def review(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """STM-20: decisions with the state of their last review (decision_id, state, reviewed_at; of several at one time the greatest), unreviewed
    without one."""
    last = events.groupBy("decision_id").agg(F.max(F.struct("reviewed_at", "state"))["state"].alias("review_state"))
    return decisions.join(last, "decision_id", "left").withColumn("review_state", F.coalesce("review_state", F.lit("unreviewed")))
