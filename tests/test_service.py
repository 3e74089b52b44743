from pyspark.sql import functions as F

from tessera.operators import index, service
from tessera.sources import probe, projects


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_negotiation(spark):
    schema = "id int, required_contracts array<string>, required_workers array<string>, requested int, configured int, serial_allowed boolean"
    plans = spark.createDataFrame([(1, ["a"], ["w"], 9, 4, True), (2, ["a", "z"], ["w"], 1, 1, True), (3, ["a"], ["v"], 1, 1, False)], schema)
    cap = lambda state, cancel=True: spark.createDataFrame([(state, ["a"], ["w"], cancel, 3)], "service_state string, contracts array<string>, workers array<string>, cancellation boolean, max_concurrency int")
    got = lambda c: rows(service.negotiate(plans, c).select("id", "state", "reason", "concurrency"))
    assert got(cap("ready")) == [(1, "dispatch_ready", None, 3), (2, "rejected", "unsupported_contract", None), (3, "rejected", "worker_not_admitted", None)]
    assert got(cap("degraded"))[0] == (1, "serial_fallback", None, 1) and got(cap("degraded"))[2] == (3, "rejected", "serial_fallback_not_permitted", None)
    assert {r[2] for r in got(cap("ready", False))} == {"cancellation_unsupported", "unsupported_contract", "worker_not_admitted"}
    assert {r[2] for r in got(cap("odd"))} == {"unsupported_state"}


def test_receipts(spark):
    shards = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "c"), ("s4", "d"), ("s5", "e")], "shard_id string, source_ref string")
    done = spark.createDataFrame([("a", "ready", None, ["x"], [], 2, "art", 5), ("b", "denied", "ineligible_source", [], [], 0, "b", 5), ("c", "ready", None, [], [], 0, "c", 99), ("d", "unavailable", "dependency_unavailable", [], [], 0, "d", 1)], "source_ref string, state string, reason string, blocks array<string>, sections array<string>, tables_detected int, artifact_id string, duration_ms int")
    got = rows(service.build_receipts(shards, done, 50).select("shard_id", "receipt_state", "reason_code", "content_blocks", "tables_detected", "artifact_id"))
    assert got == [("s1", "complete", None, 1, 2, "art"), ("s2", "denied", "source_ineligible", 0, 0, None), ("s3", "timed_out", "deadline_exceeded", 0, 0, None), ("s4", "failed", "worker_unavailable", 0, 0, None), ("s5", "failed", "internal_error_redacted", 0, 0, None)]
    state = service.receipt_state(F.lit("ready"), F.lit(False))
    assert spark.range(1).select(state.alias("s"), service.receipt_reason(F.lit("ready"), F.lit(None), F.lit(False)).alias("r")).first()[:] == ("failed", "output_contract_violation")
    retried = spark.createDataFrame([("worker_unavailable", "failed", 1), ("worker_unavailable", "failed", 2), ("source_ineligible", "denied", 1)], "reason_code string, receipt_state string, attempts int")
    assert service.retry_plan(retried).count() == 1


def test_statuses(spark):
    s = spark.createDataFrame([("r", "partial_success", 1, 0, 2, False, 3, 1), ("q", "running", 0, 0, 0, True, 0, 0)], "run_id string, run_state string, failed int, missing int, stale int, fallback_used boolean, hits int, misses int")
    got = {r.run_id: r for r in service.run_statuses(s, spark.createDataFrame([("r", "b"), ("r", "a"), ("r", None)], "run_id string, reason_code string"), True).collect()}
    assert (got["r"].mode, got["r"].controls, got["r"].reasons, got["r"].label) == ("mixed_cache_parallel", ["rerun_failed_shards", "clear_changed_source_cache"], ["a", "b"], "Partial Success")
    assert (got["q"].mode, got["q"].controls, got["q"].reasons) == ("serial_fallback", ["cancel_run"], [])
    c = spark.createDataFrame([("a", True), ("b", False)], "component string, implemented boolean")
    assert service.service_status(c, ["a", "b"]).first()[:] == ("degraded", ["b"]) and service.service_status(c, ["a"]).first()[:] == ("ready", []) and service.service_status(c, ["z"]).first().state == "unavailable"


def test_contracts(spark):
    d = spark.createDataFrame([("edge-1", "e", 1), ("edge-x-1", "x", 1), ("edge-x-2", "x", 2)], "file string, kind string, version int")
    assert rows(service.contract_sets(d, {"edge": "e", "edge-x": "x", "none": "n"})) == [("edge", 1, True), ("edge-x", 2, False), ("none", 0, False)]
    f = spark.createDataFrame([("a-ok", True), ("a-not", False), ("a-b-ok", True)], "file string, valid boolean")
    assert rows(service.conformance(f, ["a", "a-b", "c"])) == [("a", 1, 1, True), ("a-b", 1, 0, False), ("c", 0, 0, False)]
    p = spark.createDataFrame([("single", 0, None, 5), ("single", 2, ["h"], 0), ("linked", 3, ["h"], 1), ("odd", 9, None, 1)], "mode string, depth int, hosts array<string>, max_files int")
    assert [r.error_count for r in service.check_crawl_policies(p).collect()] == [0, 3, 0, 2]
    assert rows(service.failure_handoffs(spark.createDataFrame([("r", "Permission denied")], "repo string, message string"))) == [("r", "permission", "high", "operator_review", "r::permission::surface", True)]


def test_json_probes(spark):
    texts = ['{"a": {"b": [{"key": 1}]}}', '{"a": "\\"key\\": 1"}', '{"a": "key"}', "{", "[]", ' { } ', '""', "0", "null"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(service.has_any_key(F.col("t"), ["key", "other"]).alias("k"), service.is_filled(F.col("t")).alias("f")).collect()
    assert [r.k for r in got] == [True] + [False] * 8 and [r.f for r in got[4:]] == [False, False, False, True, False]
    assert spark.range(1).select(service.round3(F.lit(1.0005)).alias("x"), service.round3(F.lit(-0.0625)).alias("y")).first()[:] == (1.001, -0.063)


def test_index_reads(spark):
    files = spark.createDataFrame([(1, "b"), (2, "a")], "file_id int, path string")
    facts = spark.createDataFrame([(1, 5, "x"), (2, 6, "y"), (3, 5, "z")], "file_id int, scan_id int, name string")
    assert [r.name for r in index.scan_facts(files, facts, ["name"]).collect()] == ["y", "x"] and [r.name for r in index.scan_facts(files, facts, ["name"], 5).collect()] == ["x"]
    d = spark.createDataFrame([(1, 7, "r"), (2, 8, "r")], "decision_id int, run_id int, repository string")
    g = spark.createDataFrame([(1, 2, "b", "fail"), (1, 1, "a", "pass")], "decision_id int, gate_id int, name string, status string")
    got = {r.decision_id: [tuple(x) for x in r.gates] for r in index.with_gates(d, g).collect()}
    assert got == {1: [("a", "pass"), ("b", "fail")], 2: []}
    assert [r.run_id for r in index.find_decisions(d, repository="r").collect()] == [8, 7]
    repos = spark.createDataFrame([(1, "n")], "repo_id int, name string")
    assert index.scan_repository(repos, spark.createDataFrame([(5, 1)], "scan_id int, repo_id int"), 5).first().name == "n"


BINDER = b'<P><Binder><BinderItem UUID="u1" Type="DraftFolder"><Children><BinderItem UUID="u2" Type="Text"/></Children></BinderItem></Binder></P>'


def test_projects(spark):
    made = {"ok.scriv/p.scrivx": BINDER, "ok.scriv/Files/Data/u2/content.rtf": b"", "odd.scriv/p.scrivx": BINDER, "odd.scriv/Files/Data/u2/notes.rtf": b"", "two.scriv/a.scrivx": BINDER, "two.scriv/b.scrivx": BINDER, "bad.scriv/p.scrivx": b"<", "more.scriv/p.scrivx": BINDER, "more.scriv/Files/Data/u2/content.rtf": b"", "more.scriv/Files/Data/u9/content.rtf": b"", "x/y.txt": b""}
    got = {r.project: r for r in projects.observe_projects(spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary")).collect()}
    assert {k: (r.state, r.mapping) for k, r in got.items()} == {"ok.scriv": ("ready", "candidate_mapping_observed"), "odd.scriv": ("unavailable", "mapping_unavailable"), "two.scriv": ("unavailable", "mapping_unavailable"), "bad.scriv": ("unavailable", "mapping_unavailable"), "more.scriv": ("ready", "mapping_unresolved")}
    assert (got["ok.scriv"].depth, got["ok.scriv"]["items"], got["ok.scriv"].only_items, got["more.scriv"].only_folders) == (2, 2, 1, 1)


def test_probe(spark):
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    ask = lambda c, **k: [tuple(r.p) for r in df.select(probe.probe_with(c, **k)("t").alias("p")).collect()]
    assert ask(["cat"]) == [("ready", "abc"), ("ready", "")] and ask(["no-such-tool"])[0][0] == "unavailable" and ask(["false"])[0][0] == "failed"
    assert ask(["sleep", "5"], timeout=0.2)[0][0] == "timed_out" and ask(["cat"], most_output=2)[0][0] == "too_large"
