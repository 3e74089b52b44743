import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extraction, runs


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("x")).first().x


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb\r\nc\rd\x0be\x0cf\x1cg\x85h\u2028i", "\n", "\n\n", "x\r\n"])
def test_lines_are_those_of_python(spark, text):
    assert one(spark, T.lines(F.col("text")), text) == text.splitlines()


@pytest.mark.parametrize("line,level", [("# a", 1), ("######## a", 8), ("######### a", None), ("#a", None), ("#", None), ("a # b", None), ("##  a", 2), ("#x# a", None)])
def test_heading_grammar(spark, line, level):
    assert one(spark, T.heading_level(F.col("text")), line) == level


def test_preamble_shifts_chunks(spark):
    docs = spark.createDataFrame([(1, "before\n\n# One\n\na\n\nb\n\n## Two\nc")], "doc_id long, text string")
    p = extraction.packages(extraction.extract(docs, F.lit("r"), F.lit("s"))).first()
    assert [(b.kind, b.text) for b in p.blocks] == [("paragraph", "before"), ("heading", "One"), ("paragraph", "a"), ("paragraph", "b"), ("heading", "Two"), ("paragraph", "c")]
    assert [(s.block_count, s.start) for s in p.sections] == [(3, 0), (2, 3)]
    assert [c.text for c in p.chunks] == ["before\n\nOne\n\na", "b\n\nTwo"]


def test_refusals(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "x" * 20001), (4, "# " + "h" * 301), (5, " \n\t\n"), (6, "# only")], "doc_id long, text string")
    e = extraction.packages(extraction.extract(docs, F.lit("r"), F.col("doc_id").cast("string")))
    got = {r.doc_id: (r.state, r.reason, r.package_reason) for r in e.collect()}
    denied = lambda why: ("denied", why, "ineligible_extraction")
    assert got == {1: denied("unsupported_source_type"), 2: denied("unsupported_source_type"), 3: denied("ineligible_source"), 4: denied("ineligible_source"), 5: denied("unsupported_source_type"), 6: ("ready", None, None)}


def test_pages_do_not_share_blocks(spark):
    got = one(spark, extraction.page_blocks(F.col("text")), "a\nb\fc\n\nd\f\f")
    assert [(b.page, b.text) for b in got] == [(1, "a\nb"), (2, "c"), (2, "d")]


@pytest.mark.parametrize("counts,state", [((0, 0, 0, 0, 0, 0, 0), "failed"), ((2, 2, 0, 0, 0, 0, 0), "ready"), ((2, 2, 0, 0, 0, 0, 1), "partial_success"), ((2, 0, 0, 2, 0, 0, 0), "stale"), ((2, 0, 0, 1, 0, 1, 0), "failed"), ((2, 0, 0, 0, 2, 0, 0), "cancelled"), ((2, 0, 1, 0, 1, 0, 0), "failed")])
def test_run_state(spark, counts, state):
    assert spark.range(1).select(runs.run_state(*map(F.lit, counts)).alias("s")).first().s == state


def test_receipts_before_the_accepted_one_are_mismatches(spark):
    shards = spark.createDataFrame([("r", "s", "d")], "run_id string, shard_id string, digest string")
    rows = [("r", "s", 1, "complete", "x", "x"), ("q", "s", 2, "complete", "d", "d"), ("r", "s", 3, "stale", "d", "d"), ("r", "s", 4, "stale", "d", "e"), ("r", "s", 5, "complete", "d", "d"), ("r", "t", 6, "complete", "d", "d")]
    receipts = spark.createDataFrame(rows, "run_id string, shard_id string, seq int, state string, before string, after string")
    got = [r.reason for r in runs.judge_receipts(shards, receipts).orderBy("seq").collect()]
    assert got == ["source_fingerprint_mismatch", "run_id_mismatch", "source_fingerprint_mismatch", None, "duplicate_shard", "shard_id_mismatch"]


def test_run_package_numbers_chunks_through(spark):
    shards = spark.createDataFrame([("r", "b", 1, "y"), ("r", "a", 0, "x"), ("r", "c", 2, "z")], "run_id string, shard_id string, ordinal int, source_ref string")
    receipts = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "complete"), ("b", 1, "complete"), ("c", 1, "complete"), ("c", 2, "failed")], "shard_id string, seq int, state string")
    chunks = spark.createDataFrame([(s, k, "p", f"{s}{k}") for s in "abc" for k in range(2)], "shard_id string, local int, kind string, text string")
    got = runs.run_package(shards, receipts, chunks).orderBy("ordinal").collect()
    assert [(r.ordinal, r.text) for r in got] == [(0, "a0"), (1, "a1"), (2, "b0"), (3, "b1")]


def test_small_functions(spark):
    got = spark.range(1).select(
        T.squeeze(F.lit(" a\u00a0 b\t\nc ")).alias("squeeze"), T.clip(F.lit("aéb"), 2).alias("clip"), T.clip(F.lit("ab"), 2).alias("whole"), T.comma_list(F.array(*map(F.lit, "abc"))).alias("list"),
        T.uuid5(F.lit("https://example.org")).alias("uuid"), T.strict_epoch(F.lit("1970-01-02T00:00:00Z")).alias("epoch"), T.strict_epoch(F.lit("1970-01-02 00:00:00")).alias("none"),
        T.shell_function(F.lit("function go() {")).alias("f"), T.shell_function(F.lit("  do-it () {")).alias("g"), T.failure_route(F.lit("read timed out")).alias("route"), T.is_json(F.lit("{]")).alias("json"),
    ).first()
    import uuid

    assert (got.squeeze, got.clip, got.whole, got.list) == ("a b c", "a...", "ab", "a, b, and c")
    assert got.uuid == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org"))
    assert (got.epoch, got.none, got.f, got.g, got.route.kind, got.json) == (86400, None, "go", "do-it", "timeout", False)


def test_hashes(spark):
    from tessera.functions.hashing import canonical_hash, fnv1a

    rows = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("",), ("a",), ("foobar",), (None,)], "t string").select("t", canonical_hash("t").alias("c"), fnv1a("t").alias("f")).collect()
    import hashlib

    assert rows[0].c == "sha256:" + hashlib.sha256(b'{"a":"\\u00e9","b":1}').hexdigest()
    assert [r.f for r in rows[1:]] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", None]
