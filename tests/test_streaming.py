import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import queue
from tessera.operators.sessions import reconciles
from tessera.streaming import leases

T0 = dt.datetime(2024, 1, 1)


def rows(spark, tmp_path, batches, schema, make, name):
    src = tmp_path / "in"
    src.mkdir()
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(src / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_leases_run_out_and_ends_are_idempotent(spark, tmp_path):
    schema = "item_id string, kind string, at timestamp"
    batches = [[("a", "claim", at(0)), ("b", "claim", at(0))], [("a", "heartbeat", at(50)), ("a", "complete", at(60)), ("a", "complete", at(70))], [("c", "claim", at(100000))], [("c", "heartbeat", at(100001))], [("c", "heartbeat", at(100002))]]
    got = rows(spark, tmp_path, batches, schema, lambda s: leases.lease_stream(s, 100, "0 seconds"), "leases")
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    by = {}
    for r in sorted(got, key=lambda r: (r.at, r.state)):
        by.setdefault(r.item_id, []).append((r.state, r.at - base))
    assert by["a"] == [("claimed", 0), ("claimed", 50), ("completed", 60)]
    assert by["b"] == [("claimed", 0), ("reclaimed", 100)]


def test_watch_flushes_after_silence(spark, tmp_path):
    schema = "root string, path string, ts timestamp"
    batches = [[("r", "a", at(0)), ("r", "b", at(600)), ("r", "a", at(5000))], [("r", "z", at(10**6))], [("r", "z", at(10**6 + 1))]]
    got = rows(spark, tmp_path, batches, schema, lambda s: leases.watch_stream(s), "watch")
    assert sorted((r.changes, r.paths, r.dirty) for r in got) == [(1, 1, ["a"]), (2, 2, ["a", "b"])]


def test_full_scans_follow_silence(spark):
    flushes = spark.createDataFrame([("r", 0), ("r", 25), ("r", 35), ("s", 7)], "root string, at long")
    got = reconciles(flushes, "root", "at", 10, F.lit(60)).collect()
    assert sorted((r.root, r.at) for r in got) == [("r", 10), ("r", 20), ("r", 45), ("r", 55), ("s", 17), ("s", 27), ("s", 37), ("s", 47), ("s", 57)]


def test_report_sums_blocking_issues(spark):
    items = spark.createDataFrame([("a", 2), ("b", 3), ("c", None)], "item_id string, blocking int")
    e = spark.createDataFrame([("a", 1, "reclaimed"), ("a", 2, "completed"), ("b", 1, "failed"), ("z", 1, "failed")], "item_id string, attempt long, state string")
    got = {(r.kind, r.key): (r.n, r.blocking) for r in queue.report(queue.item_states(items, e), e).collect()}
    assert got == {
        ("item", "completed"): (1, 2), ("item", "failed"): (1, 3), ("item", "queued"): (1, 0), ("claim", "completed"): (1, 2), ("claim", "failed"): (1, 3),
        ("episode", "reclaimed"): (1, 2), ("episode", "completed"): (1, 2), ("episode", "failed"): (1, 3), ("completion", "all"): (1, 2), ("failure", "all"): (1, 3), ("reclaim", "all"): (1, 2),
    }


def test_episodes_in_batch(spark):
    ev = [(1, 1, "claim", "w", 0), (1, 2, "complete", "w", 5), (1, 3, "fail", "w", 6), (2, 4, "claim", "w", 0), (2, 5, "heartbeat", "w", 9), (2, 6, "reclaim", "w", 10), (2, 7, "claim", "v", 11), (3, 8, "heartbeat", "w", 1)]
    e = queue.episodes(spark.createDataFrame(ev, "item_id long, event_id long, kind string, actor string, at long"))
    assert sorted((r.item_id, r.attempt, r.state, r.heartbeats) for r in e.collect()) == [(1, 1, "completed", 0), (2, 1, "reclaimed", 1), (2, 2, "active", 0)]
    states = queue.item_states(spark.createDataFrame([(1,), (2,), (3,)], "item_id long"), e)
    assert {r.item_id: r.status for r in states.collect()} == {1: "completed", 2: "claimed", 3: "queued"}
    x = queue.expired(e, F.lit(100), F.lit(None).cast("long"), F.lit(89)).collect()
    assert [(r.item_id, r.expiry, r.expiry_source) for r in x] == [(2, 100, "claim")]


def test_receipts_must_agree(spark):
    claims = spark.createDataFrame([("c", 1, "i", "w", 5)], "claim_id string, attempt int, item_id string, claimant string, claimed_at long")
    r = [("c", 1, "i", "w", 5, 1), ("c", 1, "i", "w", 5, 2), ("c", 2, "i", "w", 5, 3), ("c", 1, "i", "v", 5, 4), ("d", 1, "i", "w", 5, 5)]
    got = queue.check_receipts(claims, spark.createDataFrame(r, "claim_id string, attempt int, item_id string, claimant string, claimed_at long, seq int")).orderBy("seq").collect()
    assert [x.outcome for x in got] == ["accepted", "already_ended", "attempt_mismatch", "claimant_mismatch", "claim_missing"]


def test_envelopes(spark):
    e = queue.envelope(spark.createDataFrame([('{"a":1}',)], "payload string"))
    assert queue.accept_envelopes(e).first().accepted
    assert queue.accept_envelopes(e.withColumn("payload", F.lit("{}")).withColumn("version", F.lit(2))).first().reasons == ["contract_version", "fingerprint_mismatch"]


def test_a_rescan_deletes_only_at_its_end(spark, tmp_path):
    """A batch is part of a scan: what it does not hold stays, until a row without a path ends the scan."""
    schema = "path string, sha256 string, status string, scan long"
    source, table = str(tmp_path / "seen"), str(tmp_path / "table")
    batches = [[("a", "1", "parsed", 1), ("b", "1", "parsed", 1)], [("a", "2", "parsed", 2)], [(None, None, None, 2)]]
    want = [{"a": ("1", "parsed"), "b": ("1", "parsed")}, {"a": ("2", "parsed"), "b": ("1", "parsed")}, {"a": ("2", "parsed"), "b": (None, "deleted")}]
    for n, (batch, rows_) in enumerate(zip(batches, want, strict=True)):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        leases.rescan_stream(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(60)
        assert {r.path: (r.sha256, r.status) for r in spark.read.parquet(f"{table}/v{n}").collect()} == rows_
