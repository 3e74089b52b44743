import datetime as dt
import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import crawl, extraction, queue, references, runs, service
from tessera.sources import readers
from tessera.streaming import leases

T0 = dt.datetime(2024, 1, 1)


def test_folders_of_documents(spark, tmp_path):
    q = tmp_path / "items"
    q.mkdir()
    for name, text in {"b.json": '{"item_id": "b"}', "a.json": '{"item_id":\n "a"}', "index.json": '{"item_id": "x"}'}.items():
        (q / name).write_text(text)
    assert [r.item_id for r in readers.read_queue(spark, str(q), "item_id string").orderBy("file").collect()] == ["a", "b"]
    (q / "bad.json").write_text("{")
    assert {r.path[-8:]: r.valid for r in readers.read_manifests(spark, str(q)).collect()}["bad.json"] is False
    (tmp_path / "e.json").write_text(json.dumps({"repository": "r", "revision": "v", "files": [{"path": "a", "status": "parsed"}, {"path": "b", "status": "deleted"}]}))
    got = readers.read_export(spark, str(tmp_path / "e.json"), "path string, status string").orderBy("path").collect()
    assert [(r.repository, r.path, r.status) for r in got] == [("r", "a", "parsed"), ("r", "b", "deleted")]
    docs = readers.required_documents(spark, spark.createDataFrame([("README.md",)], "path string"), ["README.md", "SYSTEM.md"])
    assert {(r.target, r.polarity) for r in docs.collect()} == {("doc:README.md", "supports"), ("doc:SYSTEM.md", "refutes")}
    assert readers.host_tools("no-such-tool") == {"no-such-tool": False}


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a").write_text("1")
    run("add", "a")
    run("commit", "-qm", "x")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b").write_text("2")
    run("add", "d/b")
    r = readers.repository(spark, str(tmp_path / "d")).first()
    assert r.root == str(tmp_path) and r.ref == "main" and len(r.commit) == 40
    assert [x.path for x in readers.staged_paths(spark, str(tmp_path)).collect()] == ["d/b"]


def test_package_manifest_skips_with_reasons(spark):
    text = json.dumps({"devDependencies": {"b": "o/r", "a": "^1.0"}, "dependencies": {"z": "https://github.com/o/z", "n": None}, "optionalDependencies": {"q": "o/q"}})
    files = spark.createDataFrame([("r", "package.json", text), ("r", "bad", "{"), ("r", "none", None)], "repo string, path string, text string")
    got = [(r.name, r.reason) for r in references.package_references(files).orderBy("at").collect()]
    assert got == [("n", "non_string_dependency_value"), ("z", None), ("a", "non_repo_style_dependency_reference"), ("b", None)]
    assert [r.edge_id for r in references.package_edges(files).orderBy("edge_id").collect()] == ["package-edge-1", "package-edge-2"]


def test_shell_and_headings(spark):
    files = spark.createDataFrame([("s", "sh", "function go {\nx() {\n. ./env.sh  a\nsource b\n# TODO FIXME\n"), ("m", "md", "  ## Two words \n####### no\n#\tTab\n#no")], "path string, lang string, text string")
    facts = crawl.line_facts(files)
    got = {(r.path, r.line_no, r.kind, r.name) for r in crawl.symbols(facts).collect()}
    assert got == {("s", 1, "function", "go"), ("s", 2, "function", "x"), ("s", 5, "marker", "TODO"), ("s", 5, "marker", "FIXME"), ("m", 1, "heading2", "Two words"), ("m", 3, "heading1", "Tab")}
    assert [(r.line_no, r.target) for r in crawl.include_edges(facts).orderBy("line_no").collect()] == [(3, ". ./env.sh a"), (4, "source b")]
    assert [r.start_byte for r in facts.filter("path = 's'").orderBy("line_no").collect()] == [0, 14, 20, 34, 43]


def test_targets_and_files(spark):
    files = spark.createDataFrame([("a/b", "py", "parsed"), ("ab", "sh", "deleted"), ("a", "py", "parsed")], "path string, lang string, status string")
    assert {r.path for r in crawl.in_targets(files, ["a"]).collect()} == {"a", "a/b"} and crawl.in_targets(files, []).count() == 3
    assert [r.path for r in crawl.query_files(files, lang="py").collect()] == ["a", "a/b"]
    stored = spark.createDataFrame([("a/x", "h"), ("b/x", "h")], "path string, sha256 string")
    assert crawl.detect_changes(stored, stored.limit(0), ["a"]).collect()[0].path == "a/x"


def test_cache(spark):
    rec = spark.createDataFrame([("d1", "w", "h1", "ready", None, T0), ("d1", "w", "h2", "ready", None, T0 + dt.timedelta(days=1)), ("d2", "w", "h3", "ready", None, T0 - dt.timedelta(days=40))], "digest string, worker string, receipt_hash string, cache_state string, invalidated_at timestamp, created_at timestamp")
    shards = spark.createDataFrame([("d1", "w"), ("d1", "v"), ("d2", "w")], "digest string, worker string")
    now = F.lit(T0 + dt.timedelta(days=2))
    found = runs.cache_lookup(shards, rec, now)
    assert sorted((r.digest, r.worker, r.receipt_hash) for r in found.filter("hit").collect()) == [("d1", "w", "h2")]
    assert runs.cache_outcome(found).first()[:] == (1, 2)
    gone = runs.invalidate(rec, spark.createDataFrame([("s", "d1", "d9")], "source_ref string, old string, new string"), now)
    assert {(r.digest, r.cache_state) for r in gone.collect()} == {("d1", "invalidated"), ("d2", "ready")}


def test_handoffs_and_ids(spark):
    docs = extraction.packages(extraction.extract(spark.createDataFrame([(1, "text"), (2, "")], "id long, text string"), F.lit("r"), F.col("id").cast("string")))
    got = service.semantic_handoffs(docs, "me", F.lit("h")).collect()
    assert len(got) == 1 and got[0].source_state == "ready" and not got[0].raw_content_included and got[0].details_redacted
    u = "6BA7B811-9DAD-11D1-80B4-00C04FD430C8"
    assert spark.range(1).select(T.correlation_uuid(F.lit(u)).alias("u")).first().u == u.lower()
    claims = queue.number_claims(spark.createDataFrame([("i", 1, "claim", "w", 1), ("i", 2, "fail", "w", 2), ("i", 3, "claim", "w", 3)], "item_id string, event_id int, kind string, actor string, at long")).orderBy("attempt").collect()
    assert [c.attempt for c in claims] == [1, 2] and len({c.claim_id for c in claims}) == 2


def test_streams_of_items_and_scans(spark, tmp_path):
    def feed(name, schema, batches):
        src = tmp_path / name
        src.mkdir()
        for k, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(src / f"b{k}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))

    items = feed("items", "item_id string, at timestamp", [[("a", T0), ("a", T0)], [("a", T0), ("b", T0)]])
    q = leases.enqueue_stream(items).writeStream.format("memory").queryName("enq").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.item_id for r in spark.table("enq").collect()) == ["a", "b"]
    files = feed("files", "path string, sha256 string, status string, scan long", [[("x", "1", "parsed", 0), ("y", "1", "parsed", 0)], [("x", "1", "parsed", 1), ("z", "2", "parsed", 1), (None, None, None, 1)]])  # the scan has ended
    leases.rescan_stream(files, str(tmp_path / "t"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(180)
    got = {r.path: (r.status, r.first_scan, r.changed_scan, r.seen_scan) for r in spark.read.parquet(str(tmp_path / "t" / "v1")).collect()}
    assert got == {"x": ("parsed", 0, 0, 1), "y": ("deleted", 0, 1, 0), "z": ("parsed", 1, 1, 1)}
