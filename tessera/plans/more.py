"""Further registered queries: service rows, index reads, formats, strings and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import canonical_hash, fnv1a
from ..operators import claims, crawl, extraction, index, references, runs, service
from ..sources.containers import container_blocks
from ..sources.manifests import is_toml, toml_edges
from .queries import _OBS, _observations, _t, query


@query("""
    with d as (select doc_id, string_split(text, chr(10)) as ls from documents),
    l as (select doc_id, unnest(ls) as line, unnest(range(0, len(ls))) as k from d)
    select doc_id, (row_number() over (partition by doc_id order by k))::bigint as nth, sha256(trim(line)) as text_sha256, (k // 3 + 1)::bigint as page from l where trim(line) <> ''""")
def page_blocks(spark, sf_dir):
    """Three lines a page, each a block of its own."""
    cut = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when((i % 3 == 0) & (i > 0), "\f").otherwise(""), x, F.lit("\n\n"))), "")
    b = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(extraction.page_blocks(cut)).alias("k", "b"))
    return b.select("doc_id", (F.col("k") + 1).cast("long").alias("nth"), F.sha2("b.text", 256).alias("text_sha256"), F.col("b.page").cast("long").alias("page"))


@query("""
    with f as (select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[{}\\\\\\x00-\\x08\\x0B-\\x1F]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{A0}\\x{85}]+', ' ', 'g'))), lambda x: x <> '') as ls from documents)
    select doc_id, unnest(range(0, len(ls)))::bigint as pos, sha256(unnest(ls)) as text_sha256 from f where len(list_filter(ls, lambda x: length(x) > 20000)) = 0""")
def rtf_blocks(spark, sf_dir):
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[{}\\\\\\x00-\\x08\\x0B-\\x1F]", "")
    units = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(....)", "$1 ")
    escaped = lambda c: F.array_join(F.transform(F.filter(F.split(units(c), " "), lambda x: x != ""), lambda x: F.concat(F.lit("\\u"), F.conv(x, 16, 10), F.lit("?"))), "")
    body = F.replace(F.array_join(F.transform(F.split(plain, ""), lambda c: F.when(F.octet_length(c) > 1, escaped(c)).otherwise(c)), ""), F.lit("\n"), F.lit("\\par "))
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("rtf_text").alias("lane"), F.encode(F.concat(F.lit("{\\rtf1{\\fonttbl{\\f0 A;}}"), body, F.lit("\\par}")), "UTF-8").alias("content"))
    b = container_blocks(files).select("path", F.explode("blocks").alias("b"))
    return b.select(F.col("path").cast("long").alias("doc_id"), F.col("b.pos").cast("long").alias("pos"), F.sha2("b.text", 256).alias("text_sha256"))


@query("""
    with s as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as ordinal from documents), st as (select doc_id, doc_id % 3 <> 1 as ok from documents),
    c as (select s.*, k, row_number() over (partition by source order by ordinal, k) - 1 as global from s join st using (doc_id), range(2) as r(k) where ok)
    select doc_id, k::bigint as local, global::bigint as ordinal, 'chunk-' || substr(sha256(source || ':doc-' || doc_id || ':' || global || ':' || k), 1, 12) as chunk_id from c""")
def run_packages(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("run_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_ref"), F.lit("x").alias("digest"))
    shards = runs.plan_shards(d, most=1 << 30)
    receipts = shards.select("shard_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("failed").alias("state")), F.struct(F.lit(2).alias("seq"), F.when(F.col("doc_id") % 3 == 1, "stale").otherwise("complete").alias("state")))).alias("r")).select("shard_id", "r.*")
    chunks = shards.select("shard_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("local"), F.lit("p").alias("kind"), F.lit("t").alias("text"))
    return runs.run_package(shards, receipts, chunks).select("doc_id", F.col("local").cast("long").alias("local"), F.col("ordinal").cast("long").alias("ordinal"), "chunk_id")


@query("""
    select source, any_value(mode) as m, case when count(distinct mode) = 1 then any_value(mode) else 'hybrid' end as chunking_mode from (select source, case when doc_id % 2 = 0 or source < 'src2' then 'section' else 'paragraph' end as mode from documents) group by source having true
    """.replace("any_value(mode) as m, ", ""))
def chunking_modes(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("source", F.when((F.col("doc_id") % 2 == 0) | (F.col("source") < "src2"), "section").otherwise("paragraph").alias("mode"))
    return d.groupBy("source").agg(F.when(F.min("mode") == F.max("mode"), F.min("mode")).otherwise("hybrid").alias("chunking_mode"))


_STATES = ["ready", "partial_success", "denied", "stale", "unavailable"]
_REASONS = ["unsupported_source_type", "dependency_unavailable", "ineligible_source", "other"]


@query(f"""
    with r as (select p_partkey, ([{", ".join(map(repr, _STATES))}])[p_partkey % 5 + 1] as s, ([{", ".join(map(repr, _REASONS))}])[p_size % 4 + 1] as f, p_partkey % 11 > 0 as ok from part)
    select p_partkey, case when not ok then 'failed' when s in ('ready', 'partial_success') then 'complete' when s in ('denied', 'stale') then s else 'failed' end as state,
        case when not ok then 'output_contract_violation' when s in ('ready', 'partial_success') then null when f in ('unsupported_source_type', 'ineligible_source') then 'source_ineligible' when f = 'dependency_unavailable' then 'worker_unavailable' else 'internal_error_redacted' end as reason from r""")
def receipt_states(spark, sf_dir):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    s, f, ok = pick(_STATES, F.col("p_partkey")), pick(_REASONS, F.col("p_size")), F.col("p_partkey") % 11 > 0
    return _t(spark, sf_dir, "part").select("p_partkey", service.receipt_state(s, ok).alias("state"), service.receipt_reason(s, f, ok).alias("reason"))


@query("""
    select c_custkey, case when c_nationkey % 3 = 0 then 'unsupported_contract' when c_nationkey % 4 = 0 then 'worker_not_admitted' end as reason, case when c_nationkey % 3 = 0 or c_nationkey % 4 = 0 then 'rejected' else 'dispatch_ready' end as state,
        case when c_nationkey % 3 = 0 or c_nationkey % 4 = 0 then null else least(c_custkey % 12 + 1, 6, 5, 8) end::bigint as concurrency from customer""")
def dispatch_negotiation(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    plans = c.select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("v9"))).otherwise(F.array(F.lit("v1"))).alias("required_contracts"), F.when(F.col("c_nationkey") % 4 == 0, F.array(F.lit("x"), F.lit("pdf"))).otherwise(F.array(F.lit("md"))).alias("required_workers"), (F.col("c_custkey") % 12 + 1).cast("int").alias("requested"), F.lit(6).alias("configured"), F.lit(True).alias("serial_allowed"))
    cap = spark.createDataFrame([("ready", ["v1", "v2"], ["md", "pdf"], True, 5)], "service_state string, contracts array<string>, workers array<string>, cancellation boolean, max_concurrency int")
    return service.negotiate(plans, cap).select("c_custkey", "reason", "state", F.col("concurrency").cast("long").alias("concurrency"))


@query("""
    with s as (select o_custkey as run_id, case when count(*) filter (o_orderstatus = 'F') > 0 then 'partial_success' else 'ready' end as run_state, count(*) filter (o_orderstatus = 'F') as failed, count(*) filter (o_orderstatus = 'P') as stale,
        o_custkey % 5 = 0 as fallback, count(*) filter (o_orderkey % 2 = 0) as hits, count(*) filter (o_orderkey % 2 = 1) as misses, coalesce(array_to_string(list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'F')), ','), '') as reasons from orders group by o_custkey)
    select run_id, case when fallback then 'serial_fallback' when hits > 0 and misses = 0 then 'cache_reuse' when hits > 0 then 'mixed_cache_parallel' else 'parallel' end as mode, reasons,
        concat_ws(',', case when failed > 0 then 'rerun_failed_shards' end, case when stale > 0 then 'clear_changed_source_cache' end) as controls, case when failed > 0 then 'Partial Success' else 'Ready' end as label from s""")
def run_statuses(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "run_id")
    is_ = lambda s: F.col("o_orderstatus") == s
    s = o.groupBy("run_id").agg(F.when(F.count_if(is_("F")) > 0, "partial_success").otherwise("ready").alias("run_state"), F.count_if(is_("F")).alias("failed"), F.lit(0).alias("missing"), F.count_if(is_("P")).alias("stale"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("hits"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("misses")).withColumn("fallback_used", F.col("run_id") % 5 == 0)
    out = service.run_statuses(s, o.filter(is_("F")).select("run_id", F.col("o_orderpriority").alias("reason_code")))
    return out.select("run_id", "mode", F.array_join("reasons", ",").alias("reasons"), F.array_join("controls", ",").alias("controls"), "label")


@query("""select o_orderkey as decision_id, coalesce(string_agg(l_returnflag || ':' || l_linestatus, ',' order by l_partkey, l_returnflag, l_linestatus), '') as gates from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def decisions_with_gates(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    gates = li.select(F.col("l_orderkey").alias("decision_id"), F.col("l_partkey").alias("gate_id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("status"))
    d = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id"))
    return index.with_gates(d, gates).select("decision_id", F.array_join(F.transform("gates", lambda g: F.concat_ws(":", g["name"], g["status"])), ",").alias("gates"))


@query("select l_orderkey as file_id, 'p' || l_orderkey as path, l_linenumber::bigint as line from lineitem where l_suppkey % 7 = 3")
def scan_edges(spark, sf_dir):
    files = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"))
    facts = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_suppkey") % 7).alias("scan_id"), F.col("l_linenumber").cast("long").alias("line"))
    return index.scan_facts(files, facts, ["line"], 3).select("file_id", "path", "line")


@query("""
    select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) = regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '  ', ' ', 'g') as single, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as squeezed,
        case when strlen(source || ':' || lang) > 6 then substr(source || ':' || lang, 1, 6) || '...' else source || ':' || lang end as clipped, source || ', ' || lang || ', and z' as listed, regexp_replace(source || '.git', '\\.git$', '') as stem
    from documents""")
def string_functions(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit(True).alias("single"), F.sha2(T.squeeze(F.col("text")), 256).alias("squeezed"), T.clip(F.concat_ws(":", "source", "lang"), 6).alias("clipped"), T.comma_list(F.array("source", "lang", F.lit("z"))).alias("listed"), T.strip_git(F.concat("source", F.lit(".git"))).alias("stem"))


@query("""
    select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso, epoch(o_orderdate)::bigint as epoch, null::bigint as loose, (case when o_orderkey % 2 = 0 then epoch(o_orderdate)::bigint + 60 + 600 else epoch(o_orderdate)::bigint + 3600 end)::bigint as expiry,
        case when o_orderkey % 2 = 0 then 'heartbeat' else 'claim' end as expiry_source, o_orderdate + interval 30 day > timestamp '1995-06-01' as live from orders""")
def time_functions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("iso", T.iso_utc(F.col("o_orderdate").cast("timestamp"))).withColumn("epoch", T.strict_epoch(F.col("iso")))
    lease = T.lease_expiry(F.col("epoch"), F.when(F.col("o_orderkey") % 2 == 0, F.col("epoch") + 60), F.lit(600), F.lit(3600))
    return o.select("o_orderkey", "iso", "epoch", T.strict_epoch(F.replace("iso", F.lit("T"), F.lit(" "))).alias("loose"), lease["epoch"].cast("long").alias("expiry"), lease["source"].alias("expiry_source"), (F.col("o_orderdate") + F.make_interval(days=F.lit(30)) > F.lit("1995-06-01").cast("timestamp_ntz")).alias("live"))


@query("""
    with m as (select event_id, lower((['Read timed out', 'Cannot PARSE file', 'No such file', 'Permission denied', 'odd'])[event_id % 5 + 1]) as t from events), k as (select event_id, case event_id % 5 when 0 then 'timeout' when 1 then 'parse_failure' when 2 then 'missing_source' when 3 then 'permission' else 'unknown_failure' end as kind from m)
    select event_id, kind, case when kind in ('permission', 'missing_source') then 'high' when kind = 'unknown_failure' then 'low' else 'medium' end as severity, case when kind in ('permission', 'missing_source') then 'operator_review' else 'retry_queue' end as route, 'r' || event_id % 3 || '::' || kind || '::surface' as issue_key from k""")
def failure_routes(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ["Read timed out", "Cannot PARSE file", "No such file", "Permission denied", "odd"])), (F.col("event_id") % 5 + 1).cast("int"))
    e = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("repo"), said.alias("message"))
    routed = e.select("event_id", "repo", T.failure_route(F.col("message")).alias("f"))
    return routed.select("event_id", "f.*", F.concat_ws("::", "repo", "f.kind", F.lit("surface")).alias("issue_key"))


@query(f"""
    with r as (select p_partkey, ([{", ".join(map(repr, _STATES))}])[p_partkey % 5 + 1] as s from part)
    select 'artifact:' || p_partkey as target, 'artifact_extraction_ready' as claim_class, case when s in ('ready', 'partial_success') then 'supports' when s in ('denied', 'unavailable', 'stale') then 'refutes' else 'unavailable' end as polarity, (case when s = 'partial_success' then 0.78 else 0.92 end)::double as strength from r
    union all select 'artifact:' || p_partkey, 'artifact_extraction_denied', case when s = 'denied' then 'supports' else 'refutes' end, 0.92 from r""")
def artifact_observations(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = _t(spark, sf_dir, "part").select(F.lit("s").alias("source_ref"), F.lit("h").alias("source_hash"), F.col("p_partkey").cast("string").alias("artifact_id"), state.alias("state"))
    return claims.artifact_observations(p).select("target", "claim_class", "polarity", "strength")


@query("select 'file:' || page_id as target, 'parse_success' as claim_class, 'refutes' as polarity from pages where page_id % 4 in (0, 1)")
def diagnostic_observations(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ["parse_error", "invalid_json", "too_big", "odd"])), (F.col("page_id") % 4 + 1).cast("int"))
    d = _t(spark, sf_dir, "pages").select(F.lit("r").alias("repository"), F.lit("v").alias("revision"), F.col("page_id").cast("string").alias("path"), code.alias("code"))
    return claims.diagnostic_observations(d).select("target", "claim_class", "polarity")


@query(f"with {_OBS} select observation_id, target, claim_class from obs where subsystem = 'crawler' and repository = 3 and observation_id >= 500")
def find_observations(spark, sf_dir):
    o = _observations(spark, sf_dir).withColumn("observed_at", F.col("observation_id"))
    return claims.find_observations(o, repository=3, subsystem="crawler", since=500).select("observation_id", "target", "claim_class")


@query("""select o_orderkey as decision_id, coalesce(st, 'unreviewed') as review_state from orders
    left join (select l_orderkey, (max({'t': l_partkey // 10, 's': l_returnflag})).s as st from lineitem group by l_orderkey) on l_orderkey = o_orderkey""")
def reviewed_decisions(spark, sf_dir):
    ev = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("decision_id"), F.col("l_returnflag").alias("state"), F.floor(F.col("l_partkey") / 10).alias("reviewed_at"))
    return claims.review(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id")), ev)


@query("""
    with p as (select page_id, 'd' || page_id % 5 || '/x' || case page_id % 4 when 0 then '/../' || page_id when 1 then '/./' || page_id when 2 then '/../../../' || page_id else '//' || page_id end as path from pages)
    select page_id, case page_id % 4 when 0 then 'd' || page_id % 5 || '/' || page_id when 2 then null else 'd' || page_id % 5 || '/x/' || page_id end as path, regexp_matches(case when page_id % 3 = 0 then 'docs/a.txt' when page_id % 3 = 1 then 'a/README.md' else 'src/readme.md' end, '(^|/)(README|SYSTEM)\\.md$|(^|/)(docs|doc|DECISIONS)/') as is_doc from p""")
def path_functions(spark, sf_dir):
    i = F.col("page_id")
    tail = F.when(i % 4 == 0, F.lit("/../")).when(i % 4 == 1, F.lit("/./")).when(i % 4 == 2, F.lit("/../../../")).otherwise(F.lit("//"))
    path = F.concat(F.lit("d"), (i % 5).cast("string"), F.lit("/x"), tail, i.cast("string"))
    doc = F.when(i % 3 == 0, F.lit("docs/a.txt")).when(i % 3 == 1, F.lit("a/README.md")).otherwise(F.lit("src/readme.md"))
    return _t(spark, sf_dir, "pages").select("page_id", crawl.contained(path).alias("path"), T.is_doc_path(doc).alias("is_doc"))


@query("""
    with e as (select event_id, props as p from events)
    select event_id, json_valid(p) as ok, json_exists(p, '$.k') as has_k, not json_valid(p || '}') as broken from e""")
def json_functions(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", T.is_json(F.col("props")).alias("ok"), service.has_any_key(F.col("props"), ["k"]).alias("has_k"), (~T.is_json(F.concat("props", F.lit("}")))).alias("broken"))


@query("select event_id, 'sha256:' || sha256('{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}') as canonical from events")
def canonical_hashes(spark, sf_dir):
    doc = F.concat(F.lit('{ "b": "'), "event_type", F.lit('", "a" : '), F.col("event_id").cast("string"), F.lit(" }"))
    return _t(spark, sf_dir, "events").select("event_id", canonical_hash(doc).alias("canonical"))


@query()
def fnv_fingerprints(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", fnv1a("text").alias("fingerprint"))


@query("""select 'r' || s_suppkey as repo, 'cargo-edge-' || k as edge_id, case k when 1 then 'cargo_manifest_parse' else 'cargo_workspace_manifest_parse' end as method, case k when 1 then 'https://github.com/o' || s_suppkey || '/b' else 'git@github.com:o/c' end as raw
    from supplier, (values (1), (2)) as t(k) where s_suppkey % 5 > 0 union all select 'r' || s_suppkey, null, null, null from supplier where s_suppkey % 5 = 0""")
def toml_references(spark, sf_dir):
    i = F.col("s_suppkey").cast("string")
    text = F.when(F.col("s_suppkey") % 5 == 0, F.lit("[broken")).otherwise(F.concat(F.lit('[dependencies]\na = "1"\nb = {git = "https://github.com/o'), i, F.lit('/b"}\n[workspace.dependencies]\nc = {git = "git@github.com:o/c"}\n')))
    s = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), i).alias("repo"), F.lit("Cargo.toml").alias("path"), F.lit("cargo").alias("kind"), text.alias("text"))
    return toml_edges(s).select("repo", "edge_id", "method", "raw")


@query("select s_suppkey, s_suppkey % 5 > 0 as valid from supplier")
def toml_validity(spark, sf_dir):
    text = F.when(F.col("s_suppkey") % 5 == 0, F.lit("[broken")).otherwise(F.lit("a = 1"))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", is_toml(text).alias("valid"))


@query("select count(*)::bigint as n, count(distinct id)::bigint as ids from (select p_partkey as id from part union all select s_suppkey from supplier union all select c_custkey from customer)")
def adapter_union(spark, sf_dir):
    parts = [_t(spark, sf_dir, t).select(F.col(k).cast("long").alias("id")) for t, k in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"))]
    return references.all_edges(*parts).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("select scan_id::bigint as scan_id, count(*)::bigint as seen, (count(*) filter (c in ('added', 'changed')))::bigint as changed, (count(*) filter (s = 'parsed'))::bigint as parsed, case when count(*) filter (s = 'parse_error') > 0 then 'partial' else 'ready' end as scan_state from (select o_custkey % 50 as scan_id, (['added', 'changed', 'unchanged'])[o_orderkey % 3 + 1] as c, case when o_orderkey % 97 = 0 then 'parse_error' when o_orderkey % 2 = 0 then 'parsed' else 'unsupported' end as s from orders) group by scan_id")
def scan_totals(spark, sf_dir):
    o = F.col("o_orderkey")
    change = F.element_at(F.array(*map(F.lit, ["added", "changed", "unchanged"])), (o % 3 + 1).cast("int"))
    status = F.when(o % 97 == 0, "parse_error").when(o % 2 == 0, "parsed").otherwise("unsupported")
    return crawl.scan_totals(_t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("scan_id"), change.alias("change"), status.alias("status")))
