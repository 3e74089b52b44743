"""The registered queries over the shared tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import AUTHORITY, COMPONENT_PATTERNS, DEFAULT_WEIGHTS, EXCLUDED_DIRS, EXCLUDED_EXTENSIONS, FRESHNESS, HEALTH, LANES, LANGUAGE_OF_EXTENSION, LANGUAGE_OF_NAME, WEIGHTS
from ..operators import claims, crawl, extraction, queue, references, runs
from ..operators.sessions import parity, reconciles, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)


# ---- documents with structure: each fifth line is a heading, every other a paragraph of its own


def _md(spark: SparkSession, sf_dir: str, rest: int = 0) -> DataFrame:
    marked = F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i + 1) % 5 == rest, F.concat(F.lit("## "), x)).otherwise(F.concat(x, F.lit("\n"))))
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"))


def _extracted(docs: DataFrame) -> DataFrame:
    return extraction.extract(docs, F.lit("req-1"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))


def _md_blocks(rest: int) -> str:
    """Blocks of the view, made with windows over lines."""
    return f"""
        l as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents),
        blk as (
            select doc_id, n, n % 5 = {rest} and trim(raw) <> '' as h, case when n % 5 = {rest} and trim(raw) = '' then '##' else trim(raw) end as text
            from l where trim(raw) <> '' or n % 5 = {rest}),
        b as (select *, row_number() over (partition by doc_id order by n) - 1 as pos, count(*) over (partition by doc_id) as total from blk),
        s as (
            select doc_id, pos, text as heading, row_number() over (partition by doc_id order by pos) as section,
                greatest(1, coalesce(lead(pos) over (partition by doc_id order by pos), total) - pos) as cnt,
                pos - min(pos) over (partition by doc_id) as start from b where h)"""


@query("""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents),
    g as (select *, sum(case when trim(raw) = '' then 1 else 0 end) over (partition by doc_id order by n) as island from l),
    p as (select doc_id, island, string_agg(trim(raw), chr(10) order by n) as text from g where trim(raw) <> '' group by doc_id, island)
    select doc_id, (row_number() over (partition by doc_id order by island))::bigint as block, sha256(text) as text_sha256 from p""")
def extract_paragraphs(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.explode(extraction.blocks(F.col("text"), False)).alias("b"))
    return docs.select("doc_id", (F.col("b.pos") + 1).cast("long").alias("block"), F.sha2("b.text", 256).alias("text_sha256"))


@query("""
    select doc_id, case when trim(text, ' ' || chr(10)) = '' then 'unsupported_source_type' when length(text) > 20000 then 'ineligible_source' end as reason,
        case when trim(text, ' ' || chr(10)) = '' or length(text) > 20000 then 'denied' else 'ready' end as state,
        (select count(*) from (select unnest(string_split(text, chr(10))) as x) where length(x) - length(replace(x, '|', '')) >= 2)::bigint as tables_detected
    from documents""")
def extract_refusals(spark, sf_dir):
    e = extraction.extract(_t(spark, sf_dir, "documents"), F.lit("req-1"), F.col("doc_id").cast("string"), headings=False)
    return e.select("doc_id", "reason", "state", F.col("tables_detected").cast("long").alias("tables_detected"))


@query("""
    select doc_id, (row_number() over (partition by doc_id order by n))::bigint as nth, line from (
        select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents)
    where length(line) - length(replace(line, '|', '')) >= 2""")
def table_lines(spark, sf_dir):
    found = F.filter(T.lines(F.col("text")), T.is_table_line)
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("k", "line")).select("doc_id", (F.col("k") + 1).cast("long").alias("nth"), "line")


@query(f"with {_md_blocks(0)} select doc_id, pos::bigint as pos, 2::bigint as level, heading from s")
def md_headings(spark, sf_dir):
    e = _md(spark, sf_dir).select("doc_id", F.explode(F.filter(extraction.blocks(F.col("text"), True), lambda b: b["kind"] == "heading")).alias("b"))
    return e.select("doc_id", F.col("b.pos").cast("long").alias("pos"), F.col("b.level").cast("long").alias("level"), F.col("b.text").alias("heading"))


@query(f"with {_md_blocks(1)} select doc_id, section::bigint as section, heading, cnt::bigint as block_count, start::bigint as start from s")
def md_sections(spark, sf_dir):
    e = _extracted(_md(spark, sf_dir, 1)).select("doc_id", F.explode("sections").alias("s"))
    return e.select("doc_id", F.col("s.section").cast("long").alias("section"), "s.heading", F.col("s.block_count").cast("long").alias("block_count"), F.col("s.start").cast("long").alias("start"))


@query(f"""
    with {_md_blocks(0)},
    bad as (select distinct doc_id from b where (h and length(text) > 300) or length(text) > 20000),
    c as (select s.doc_id, section - 1 as ordinal, string_agg(b.text, chr(10) || chr(10) order by b.pos) as text
        from s join b on b.doc_id = s.doc_id and b.pos >= s.start and b.pos < s.start + s.cnt group by all)
    select doc_id, ordinal::bigint as ordinal, sha256(text) as text_sha256, 'chunk-' || substr(sha256('req-1:doc-' || doc_id || ':' || ordinal || ':section'), 1, 12) as chunk_id
    from c where doc_id not in (select doc_id from bad) and doc_id not in (select doc_id from c where length(text) > 20000 or text = '')""")
def section_chunks(spark, sf_dir):
    p = extraction.packages(_extracted(_md(spark, sf_dir))).filter("mode = 'section' and package_state = 'ready'")
    return p.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", F.col("c.ordinal").cast("long").alias("ordinal"), F.sha2("c.text", 256).alias("text_sha256"), "c.chunk_id")


@query("""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents),
    g as (select *, sum(case when trim(raw) = '' then 1 else 0 end) over (partition by doc_id order by n) as island from l),
    p as (select doc_id, island, string_agg(trim(raw), chr(10) order by n) as text from g where trim(raw) <> '' group by doc_id, island),
    o as (select *, row_number() over (partition by doc_id order by island) - 1 as ordinal, max(length(text)) over (partition by doc_id) as longest from p)
    select doc_id, ordinal::bigint as ordinal, length(text)::bigint as chars, 'chunk-' || substr(sha256('req-1:doc-' || doc_id || ':' || ordinal || ':paragraph'), 1, 12) as chunk_id from o where longest <= 20000""")
def paragraph_chunks(spark, sf_dir):
    p = extraction.packages(_extracted(_t(spark, sf_dir, "documents").select("doc_id", "text"))).filter("package_state = 'ready'")
    return p.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", F.col("c.ordinal").cast("long").alias("ordinal"), F.length("c.text").cast("long").alias("chars"), "c.chunk_id")


@query("""
    select doc_id, 'extract-' || substr(sha256('req-1:doc-' || doc_id), 1, 16) as artifact_id, 'pkg-' || substr(sha256('req-1:doc-' || doc_id || ':retrieval'), 1, 16) as package_id,
        'sha256:' || sha256(text) as source_hash, 'src:' || substr(sha256(source), 1, 12) as source_token,
        'item-' || substr(sha256('intake|lane|' || source || '|h-' || lang || '|' || array_to_string(list_sort([lang, source, 'b']), ';')), 1, 24) as item_id
    from documents""")
def deterministic_ids(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    ref = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    item = T.queue_item_id(F.lit("intake"), F.lit("lane"), F.col("source"), F.concat(F.lit("h-"), "lang"), F.array("lang", "source", F.lit("b")))
    return d.select("doc_id", T.artifact_id(F.lit("req-1"), ref).alias("artifact_id"), T.package_id(F.lit("req-1"), ref).alias("package_id"), T.source_hash(F.col("text")).alias("source_hash"), T.sha256_id("src:", F.col("source"), 12).alias("source_token"), item.alias("item_id"))


# ---- admission and validation

_SUFFIXES = [".MD", ".txt", ".pdf", ".docx", ".rtf", ".odt", ".epub", ".exe", ""]
_MEDIA = [None, "text/plain", "application/pdf", "text/markdown"]


def _sources(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("p_partkey") % len(_SUFFIXES) + 1).cast("int"))
    media = F.element_at(F.array(*map(F.lit, _MEDIA)), (F.col("p_size") % len(_MEDIA) + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("dir/file"), F.col("p_partkey").cast("string"), end).alias("path"), media.alias("media_type"))


@query(f"""
    with s as (select p_partkey, 'dir/file' || p_partkey || ([{", ".join(map(repr, _SUFFIXES))}])[p_partkey % {len(_SUFFIXES)} + 1] as path, (['', 'text/plain', 'application/pdf', 'text/markdown'])[p_size % 4 + 1] as m from part),
    lane(lane, suffix, media, worker) as (values {_values((a, b, "|".join(c), w) for a, b, c, w in LANES)})
    select p_partkey, lane, worker,
        case when lane is null or (m <> '' and not list_contains(string_split(media, '|'), m)) then 'denied' when lane = 'pdf_text' then 'unavailable' end as failure_state,
        case when lane is null or (m <> '' and not list_contains(string_split(media, '|'), m)) then 'unsupported_source_type' when lane = 'pdf_text' then 'dependency_unavailable' end as reason,
        lane is not null and not (m <> '' and not list_contains(string_split(media, '|'), m)) and lane <> 'pdf_text' as admitted
    from s left join lane on lower(regexp_extract(path, '(\\.[^./]+)$', 1)) = suffix""")
def lane_admission(spark, sf_dir):
    tools = tuple(lane for lane, *_ in LANES if lane != "pdf_text")
    return extraction.admit(_sources(spark, sf_dir), tools).select("p_partkey", "lane", "worker", "failure_state", "reason", "admitted")


@query("""
    with c as (select c_custkey, list_filter([case when not c_acctbal >= 0 then 'balance: must not be negative' end, case when not regexp_matches(c_name, '[02468]$') then 'name: must end in an even digit' end,
        case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 'segment: not in the enum' end, case when not c_nationkey < 20 then 'nation: out of range' end], lambda x: x is not null) as e from customer)
    select c_custkey, len(e)::bigint as error_count, len(e) = 0 as valid, array_to_string(list_sort(e)[1:2], '; ') as errors from c""")
def intake_errors(spark, sf_dir):
    rules = [("balance", F.col("c_acctbal") >= 0, "must not be negative"), ("name", F.col("c_name").rlike("[02468]$"), "must end in an even digit"), ("segment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "not in the enum"), ("nation", F.col("c_nationkey") < 20, "out of range")]
    e = extraction.intake_errors(_t(spark, sf_dir, "customer"), rules, 2)
    return e.select("c_custkey", F.col("error_count").cast("long").alias("error_count"), "valid", F.array_join(F.transform("errors", lambda x: F.concat_ws(": ", x["path"], x["message"])), "; ").alias("errors"))


# ---- runs


@query("""
    with s as (select (doc_id // 200)::bigint as run_id, doc_id, source, sha256(text) as digest from documents),
    o as (select *, row_number() over (partition by run_id order by doc_id) - 1 as ordinal from s)
    select run_id, doc_id, ordinal::bigint as ordinal, printf('%d-shard-%04d-', run_id, ordinal) || substr(sha256(run_id || ':' || ordinal || ':' || source || ':' || digest), 1, 12) as shard_id from o""")
def shard_plan(spark, sf_dir):
    s = _t(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 200).cast("long").alias("run_id"), "doc_id", F.col("doc_id").alias("seq"), F.col("source").alias("source_ref"), F.sha2("text", 256).alias("digest"))
    return runs.plan_shards(s).select("run_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "shard_id")


def _receipts(spark, sf_dir):
    """Orders are shards of a run for each customer; lines are receipts, some of them wrong in each way."""
    shards = _t(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 3").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("shard_id"), (F.col("o_orderkey") % 1000).alias("digest"))
    li = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    state = F.when(F.col("l_returnflag") == "R", "stale").when(F.col("l_linestatus") == "O", "complete").when(F.col("l_returnflag") == "A", "failed").otherwise("cancelled")
    run = F.when(F.col("l_partkey") % 11 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey"))
    digest = F.col("l_orderkey") % 1000
    after = F.when(F.col("l_suppkey") % 5 == 0, digest + 1).otherwise(digest)
    return shards, li.select(run.alias("run_id"), F.col("l_orderkey").alias("shard_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("seq"), state.alias("state"), digest.alias("before"), after.alias("after"), F.col("l_shipdate").alias("started_at"), (F.col("l_shipdate") + F.make_interval(days=F.lit(1))).alias("completed_at"), F.col("l_quantity").cast("long").alias("duration_ms"), F.col("l_partkey"))


_RECEIPTS = """
    sh as (select o_custkey as run_id, o_orderkey as shard_id, o_orderkey % 1000 as digest from orders where o_orderkey % 7 <> 3),
    rc as (select case when l_partkey % 11 = 0 then -1 else o_custkey end as run_id, l_orderkey as shard_id, l_linenumber::bigint * 1000000000 + l_partkey * 10000 + l_suppkey as seq, l_partkey,
        case when l_returnflag = 'R' then 'stale' when l_linestatus = 'O' then 'complete' when l_returnflag = 'A' then 'failed' else 'cancelled' end as state,
        l_orderkey % 1000 as before, l_orderkey % 1000 + case when l_suppkey % 5 = 0 then 1 else 0 end as after, l_shipdate as started_at, l_shipdate + interval 1 day as completed_at, cast(l_quantity as bigint) as duration_ms
        from lineitem join orders on l_orderkey = o_orderkey),
    ea as (select rc.*, case when l_partkey % 13 = 0 then 'schema_invalid' when rc.run_id not in (select run_id from sh) then 'run_id_mismatch' when sh.shard_id is null then 'shard_id_mismatch' when rc.run_id <> sh.run_id then 'run_id_mismatch' end as early,
        case when state = 'stale' then not (before = digest and after = digest) else before = digest and after = digest end as fits
        from rc left join sh using (shard_id)),
    ju as (select *, coalesce(early, case when exists_before then 'duplicate_shard' when not fits then 'source_fingerprint_mismatch' end) as reason from (
        select *, coalesce(bool_or(early is null and fits) over (partition by shard_id order by seq rows between unbounded preceding and 1 preceding), false) as exists_before from ea))"""


def _judged(spark, sf_dir):
    shards, receipts = _receipts(spark, sf_dir)
    return shards, runs.judge_receipts(shards, receipts, F.col("l_partkey") % 13 != 0)


@query(f"with {_RECEIPTS} select shard_id, seq::bigint as seq, state, reason from ju")
def receipt_reconcile(spark, sf_dir):
    return _judged(spark, sf_dir)[1].select("shard_id", F.col("seq").cast("long").alias("seq"), "state", "reason")


@query(f"with {_RECEIPTS} select run_id, shard_id from sh where shard_id not in (select shard_id from ju where reason is null)")
def missing_shards(spark, sf_dir):
    return runs.missing_shards(*_judged(spark, sf_dir)).select("run_id", "shard_id")


@query(f"""
    with {_RECEIPTS},
    e as (select run_id, count(*) as expected from sh group by run_id),
    g as (select coalesce(sh.run_id, ju.run_id) as run_id, ju.* exclude (run_id) from ju left join sh using (shard_id)),
    p as (select run_id, count(*) filter (reason is null and state = 'complete') as completed, count(*) filter (reason is null and state in ('failed', 'denied', 'timed_out')) as failed,
        count(*) filter (reason is null and state = 'stale') as stale, count(*) filter (reason is null and state = 'cancelled') as cancelled, count(*) filter (reason is not null) as rejected,
        count(distinct shard_id) filter (reason is null) as accepted, coalesce(sum(duration_ms) filter (reason is null), 0)::bigint as duration_ms, min(started_at) filter (reason is null) as started_at, max(completed_at) filter (reason is null) as completed_at
        from g group by run_id),
    r as (select e.run_id, expected, coalesce(completed, 0) as completed, coalesce(failed, 0) as failed, coalesce(stale, 0) as stale, coalesce(cancelled, 0) as cancelled, coalesce(rejected, 0) as rejected,
        expected - coalesce(accepted, 0) as missing, coalesce(duration_ms, 0) as duration_ms, started_at, completed_at from e left join p using (run_id))
    select *, case when expected = 0 then 'failed' when completed = expected and failed + stale + cancelled + missing + rejected = 0 then 'ready' when completed > 0 then 'partial_success'
        when stale > 0 and failed + cancelled + missing = 0 then 'stale' when cancelled > 0 and failed + stale + missing = 0 then 'cancelled' else 'failed' end as run_state from r""")
def run_states(spark, sf_dir):
    return runs.reconcile(*_judged(spark, sf_dir))


@query("""
    with c as (select sha256(text) as digest, lang as worker, 'r-' || doc_id as receipt_hash, case when doc_id % 5 = 0 then 'invalidated' else 'ready' end as st, timestamp '2024-01-31' - doc_id % 60 * interval 1 day as made from documents where doc_id % 3 = 0),
    live as (select digest, worker, (max({'m': made, 'r': receipt_hash})).r as receipt_hash from c where st = 'ready' and made + interval 30 day > timestamp '2024-01-31' group by digest, worker)
    select doc_id, l.receipt_hash is not null as hit, l.receipt_hash from documents d left join live l on sha256(d.text) = l.digest and d.lang = l.worker""")
def cache_lookup(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.col("lang").alias("worker"))
    now = F.to_timestamp(F.lit("2024-01-31"))
    c = d.filter("doc_id % 3 = 0").select("digest", "worker", F.concat(F.lit("r-"), F.col("doc_id").cast("string")).alias("receipt_hash"), F.when(F.col("doc_id") % 5 == 0, "invalidated").otherwise("ready").alias("cache_state"), F.lit(None).cast("timestamp").alias("invalidated_at"), (now - F.make_interval(days=(F.col("doc_id") % 60).cast("int"))).alias("created_at"))
    return runs.cache_lookup(d, c, now).select("doc_id", "hit", "receipt_hash")


@query("""
    with a as (select doc_id as source_ref, sha256(text) as o from documents where doc_id % 10 <> 1), b as (select doc_id as source_ref, sha256(case when doc_id % 4 = 0 then text || '!' else text end) as n from documents where doc_id % 10 <> 2)
    select source_ref, o as old, n as new from a join b using (source_ref) where o <> n""")
def cache_invalidate(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    before = d.filter("doc_id % 10 <> 1").select(F.col("doc_id").alias("source_ref"), F.sha2("text", 256).alias("digest"))
    after = d.filter("doc_id % 10 <> 2").select(F.col("doc_id").alias("source_ref"), F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return runs.changed_sources(before, after)


# ---- crawling

_NAMES = ["Makefile", "src/main.rs", "web/app.tsx", "node_modules/x/index.js", "Cargo.lock", "docs/a.MD", "img/logo.PNG", "pyproject.toml", "tool.pyw", ".bashrc", "a/Build/out.bin", "x.yml", "noext"]


def _paths(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", name.alias("path"), (F.col("p_size").cast("long") * 30000).alias("size"), (F.col("p_partkey") % 17 == 0).alias("binary"))


_PATHS = f"f as (select p_partkey, ([{', '.join(map(repr, _NAMES))}])[p_partkey % {len(_NAMES)} + 1] as path, p_size::bigint * 30000 as size, p_partkey % 17 = 0 as bin from part)"


@query(f"""
    with {_PATHS}, n as (select p_partkey, lower(regexp_extract(path, '[^/]*$')) as name from f),
    byname(name, lang) as (values {_values(LANGUAGE_OF_NAME.items())}), byext(ext, lang) as (values {_values(LANGUAGE_OF_EXTENSION.items())})
    select p_partkey, coalesce(byname.lang, byext.lang, 'unknown') as lang from n left join byname using (name) left join byext on regexp_extract(name, '^.+\\.([^.]*)$', 1) = ext""")
def lang_classify(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", crawl.language(F.col("path")).alias("lang"))


@query(f"""
    with {_PATHS}, p as (select *, list_filter(string_split(lower(path), '/'), lambda x: x in ({", ".join(map(repr, EXCLUDED_DIRS))})) as dirs, regexp_extract(path, '[^/]*$') as name from f)
    select p_partkey, case when len(dirs) > 0 then 'excluded_dir:' || dirs[1] when size > 1048576 then 'size_limit:>1048576' when name = 'Cargo.lock' then 'generated_lockfile'
        when lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) in ({", ".join(map(repr, EXCLUDED_EXTENSIONS))}) then 'excluded_extension:' || lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) when bin then 'binary_denied' end as reason from p""")
def skip_policy(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", crawl.skip_reason(F.col("path"), F.col("size"), F.col("binary")).alias("reason"))


def _marked(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 7 == 0, "\n# TODO one").when(F.col("doc_id") % 7 == 1, "\n  // FIXME and TODO\n\n* x").otherwise("")
    lang = F.when(F.col("doc_id") % 2 == 0, "py").otherwise("rust")
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("text"), lang.alias("lang"))


_MARKED = """
    k as (select doc_id, text || case doc_id % 7 when 0 then chr(10) || '# TODO one' when 1 then chr(10) || '  // FIXME and TODO' || chr(10) || chr(10) || '* x' else '' end as text, case when doc_id % 2 = 0 then 'py' else 'rust' end as lang from documents),
    ln as (select doc_id, lang, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n, len(string_split(text, chr(10))) as total from k),
    lines as (select * from ln where not (n = total and line = ''))"""


@query(f"""
    with {_MARKED}
    select doc_id, count(*)::bigint as total_lines, (count(*) filter (trim(line) = ''))::bigint as blank_lines, (count(*) filter (line like '%TODO%'))::bigint as todo_count, (count(*) filter (line like '%FIXME%'))::bigint as fixme_count,
        (count(*) filter (case lang when 'py' then trim(line) like '#%' else trim(line) like '//%' or trim(line) like '/*%' or trim(line) like '*%' end))::bigint as comment_lines
    from lines group by doc_id""")
def file_metrics(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", crawl.file_metrics(F.col("lang"), F.col("text")).alias("m")).select("doc_id", "m.*")


@query(f"""
    with {_MARKED}, b as (select *, coalesce(sum(strlen(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as start_byte from lines)
    select doc_id, n::bigint as line_no, start_byte::bigint as start_byte, m as name from b, (values ('TODO'), ('FIXME')) as t(m) where contains(line, m)""")
def marker_symbols(spark, sf_dir):
    s = crawl.symbols(crawl.line_facts(_marked(spark, sf_dir))).filter("kind = 'marker'")
    return s.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start_byte").cast("long").alias("start_byte"), "name")


@query("""
    with a as (select doc_id as path, case when doc_id % 9 = 0 then null else sha256(text) end as o from documents where doc_id % 10 <> 1), b as (select doc_id as path, sha256(case when doc_id % 4 = 0 then text || '!' else text end) as n from documents where doc_id % 10 <> 2)
    select path, c as change from (select coalesce(a.path, b.path) as path, case when b.path is null and o is null then null when b.path is null then 'deleted' when o is null then 'added' when o = n then 'unchanged' else 'changed' end as c from a full join b on a.path = b.path) where c is not null""")
def change_detect(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    stored = d.filter("doc_id % 10 <> 1").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 9 != 0, F.sha2("text", 256)).alias("sha256"))
    seen = d.filter("doc_id % 10 <> 2").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return crawl.detect_changes(stored, seen)


@query("""
    with a as (select doc_id as path, case when doc_id % 9 = 0 then null else sha256(text) end as sha, case when doc_id % 9 = 0 then 'deleted' else 'parsed' end as st from documents where doc_id % 10 <> 1),
    b as (select doc_id as path, sha256(case when doc_id % 4 = 0 then text || '!' else text end) as n from documents where doc_id % 10 <> 2)
    select coalesce(a.path, b.path) as path, n as sha256, case when b.path is null then 'deleted' else 'parsed' end as status, (case when a.path is null then 9 else 1 end)::bigint as first_scan,
        (case when b.path is not null and sha = n then 2 when b.path is null and st = 'deleted' then 2 else 9 end)::bigint as changed_scan, (case when b.path is not null then 9 else 3 end)::bigint as seen_scan
    from a full join b on a.path = b.path""")
def scan_merge(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    gone = F.col("doc_id") % 9 == 0
    stored = d.filter("doc_id % 10 <> 1").select(F.col("doc_id").alias("path"), F.when(~gone, F.sha2("text", 256)).alias("sha256"), F.when(gone, "deleted").otherwise("parsed").alias("status"), *[F.lit(v).cast("long").alias(c) for c, v in (("first_scan", 1), ("changed_scan", 2), ("seen_scan", 3))])
    seen = d.filter("doc_id % 10 <> 2").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"), F.lit("parsed").alias("status"))
    return crawl.merge_files(stored, seen, F.lit(9).cast("long"))


@query("select l_orderkey as id, l_linenumber::bigint as line, p_type as path, p_name as name from lineitem join part on l_partkey = p_partkey where p_name ilike '%e_ w%'")
def symbol_search(spark, sf_dir):
    files = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_type").alias("path"), F.col("p_name").alias("name"))
    syms = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line"))
    named = syms.join(files.select("file_id", "name"), "file_id").withColumn("kind", F.lit("symbol"))
    return crawl.search_symbols(named, files.select("file_id", "path"), "E_ W").select("id", "line", "path", "name")


@query("""
    with recursive e as (select p_partkey as source, (p_partkey * 7 + 3) % 500 as target from part union select p_partkey, p_partkey // 2 from part),
    c(root, path, depth) as (select p_partkey, p_partkey, 0 from part union select root, target, depth + 1 from c join e on c.path = e.source where depth < 8),
    m as (select root, path, min(depth) as depth from c group by root, path), r as (select *, row_number() over (partition by root order by depth, path) as k from m)
    select root, path, depth::bigint as depth from r where k <= 32""")
def include_closure(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey")
    e = p.select(F.col("p_partkey").alias("source"), ((F.col("p_partkey") * 7 + 3) % 500).alias("target")).union(p.select("p_partkey", F.floor(F.col("p_partkey") / 2))).distinct()
    return crawl.include_closure(e, p.select(F.col("p_partkey").alias("path"))).select("root", "path", F.col("depth").cast("long").alias("depth"))


@query("""select o_custkey as id, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen, (max({'d': o_orderdate, 'v': v}) filter (v is not null)).v as state from (select *, case when o_orderkey % 3 <> 0 then o_orderstatus || '-' || o_orderkey end as v from orders) group by o_custkey""")
def entity_upsert(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    seen = o.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("seen_at"), F.when(F.col("o_orderkey") % 3 != 0, F.concat_ws("-", "o_orderstatus", F.col("o_orderkey").cast("string"))).alias("state"))
    return crawl.upsert_entities(seen, "id")


@query(f"select page_id, {', '.join(f'regexp_matches(html, {chr(39)}{p}{chr(39)}) as {k}' for k, p in COMPONENT_PATTERNS.items() if k != 'script_instance')}, len(list_filter(regexp_extract_all(html, '(?i)<script[^>]*>'), lambda x: not regexp_matches(x, '(?i)\\bmodule\\b'))) > 0 as script_instance from pages")
def component_flags(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.component_flags(F.col("html")).alias("f")).select("page_id", "f.*")


# ---- references

_REFS = ["https://github.com/{0}/tool.git", "git@github.com:{0}/lib", "git+ssh://git@github.com/{0}/x/", "../{0}", "./local", "{0}/action@v4", "^1.2.3", "https://github.com/{0}/a/b", "name @ git+https://github.com/{0}/z", "plain"]


def _references(spark, sf_dir):
    ref = F.element_at(F.array(*map(F.lit, _REFS)), (F.col("p_partkey") % len(_REFS) + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("repo"), (F.col("p_partkey") % 20).cast("string")).alias("repo"), F.replace(ref, F.lit("{0}"), F.concat(F.lit("o"), F.col("p_size").cast("string"))).alias("raw"))


_RESOLVED = f"""
    r as (select p_partkey, 'repo' || p_partkey % 20 as repo, replace(([{', '.join(map(repr, _REFS))}])[p_partkey % {len(_REFS)} + 1], '{{0}}', 'o' || p_size) as raw from part),
    m as (select *, regexp_extract(raw, '^git\\+ssh://git@github\\.com/+([^/]+/[^/]+?)(\\.git)?/*$', 1) as a, regexp_extract(raw, '^git@github\\.com:([^/]+/[^/]+?)(\\.git)?/*$', 1) as b,
        regexp_extract(raw, '^https://github\\.com/([^/]+/[^/]+?)(\\.git)?/*$', 1) as c, regexp_extract(raw, '^([^/]+/[^/]+?)(\\.git)?$', 1) as d from r),
    n as (select p_partkey, repo, raw, case when a <> '' or b <> '' or c <> '' then 'resolved' when regexp_matches(raw, '^\\.\\.?/') then 'ambiguous' when d <> '' then 'resolved' else 'unresolved' end as posture,
        case when a <> '' then 'git_ssh_remote_parse' when b <> '' then 'ssh_remote_parse' when c <> '' then 'https_remote_parse' when regexp_matches(raw, '^\\.\\.?/') then 'relative_path_inference' when d <> '' then 'owner_repo_direct' else 'none' end as method,
        case when a <> '' then a when b <> '' then b when c <> '' then c when regexp_matches(raw, '^\\.\\.?/') then null when d <> '' then d end as identity from m)"""


@query(f"with {_RESOLVED} select p_partkey, posture, method, identity from n")
def ref_normalize(spark, sf_dir):
    return _references(spark, sf_dir).select("p_partkey", references.normalize_reference(F.col("raw")).alias("r")).select("p_partkey", "r.*")


@query(f"with {_RESOLVED} select repo, p_partkey, repo || '::ambiguous_target::e-' || p_partkey as issue_key from n where posture = 'ambiguous'")
def edge_findings(spark, sf_dir):
    edges = _references(spark, sf_dir).withColumn("edge_id", F.concat(F.lit("e-"), F.col("p_partkey").cast("string")))
    return references.findings(references.resolve(edges)).select("repo", "p_partkey", "issue_key")


@query(f"""
    with {_RESOLVED}, k as (select repo, list_sort(list(distinct repo || '::ambiguous_target::e-' || p_partkey)) as keys from n where posture = 'ambiguous' group by repo)
    select repo, len(keys)::bigint as issues, 'item-' || substr(sha256('candidate_issues|references|' || repo || '|handoff-' || repo || '|' || array_to_string(keys, ';')), 1, 24) as item_id from k""")
def handoff_items(spark, sf_dir):
    edges = _references(spark, sf_dir).withColumn("edge_id", F.concat(F.lit("e-"), F.col("p_partkey").cast("string")))
    return references.queue_items(references.findings(references.resolve(edges))).select("repo", F.col("issues").cast("long").alias("issues"), "item_id")


def _manifests(spark, sf_dir):
    r = _references(spark, sf_dir)
    return r.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "raw"))).alias("x")).select("repo", F.col("x.raw").alias("raws"))


def _edges(spark, sf_dir):
    m = _manifests(spark, sf_dir)
    text = lambda path, line, end="": m.select("repo", F.lit(path).alias("path"), F.concat(F.array_join(F.transform("raws", line), "\n"), F.lit(end)).alias("text"))
    modules = text(".gitmodules", lambda x: F.concat(F.lit("[submodule]\n\turl = "), x))
    wanted = text("requirements.txt", lambda x: x, "\n-r more.txt\n# git+https://github.com/a/b")
    flows = text(".github/workflows/ci.yml", lambda x: F.concat(F.lit("      - uses: "), x))
    keyed = F.transform("raws", lambda x, i: F.concat(F.format_string('"d%05d": ', i), F.to_json(F.array(x))))
    package = m.select("repo", F.lit("package.json").alias("path"), F.concat(F.lit('{"dependencies": {'), F.regexp_replace(F.array_join(keyed, ", "), "\\[|\\]", ""), F.lit("}}")).alias("text"))
    return references.all_edges(references.module_edges(modules), references.requirement_edges(wanted), references.workflow_edges(flows), references.package_edges(package))


_EDGES = f"""
    {_RESOLVED},
    e as (select repo, '.gitmodules' as path, 'gitmodules' as pre, 'gitmodules_parse' as method, raw, p_partkey from r
        union all select repo, 'requirements.txt', 'requirements', 'requirements_parse', raw, p_partkey from r where contains(raw, ' @ git+') or starts_with(raw, 'git+https://') or starts_with(raw, 'git+ssh://') or contains(raw, 'github.com/')
        union all select repo, '.github/workflows/ci.yml', 'workflow', 'ci_workflow_parse', raw, p_partkey from r
        union all select repo, 'package.json', 'package', 'package_manifest_parse', raw, p_partkey from r where contains(raw, 'github.com/') or starts_with(raw, 'git@github.com:') or starts_with(raw, 'git+ssh://')
            or (contains(raw, '/') and not starts_with(raw, '^') and not starts_with(raw, '~') and not regexp_full_match(raw, '[0-9.]*')))"""


@query(f"with {_EDGES} select repo, path, method, raw, pre || '-edge-' || row_number() over (partition by repo, path order by p_partkey) as edge_id from e")
def manifest_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("repo", "path", "method", "raw", "edge_id")


@query(f"with {_EDGES} select method, path, count(*)::bigint as edges from e group by grouping sets ((method), (path))")
def adapter_counts(spark, sf_dir):
    return references.adapter_counts(_edges(spark, sf_dir))


@query("select 'part' as side, l_partkey as key from (select distinct l_partkey from lineitem) where l_partkey not in (select p_partkey from part where p_partkey % 10 <> 0) union all select 'supplier', l_suppkey from (select distinct l_suppkey from lineitem) where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 10 <> 0)")
def audit_referential(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    p = _t(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    s = _t(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    a = references.missing_keys(li, p, "l_partkey").select(F.lit("part").alias("side"), F.col("l_partkey").alias("key"))
    return a.union(references.missing_keys(li, s, "l_suppkey").select(F.lit("supplier"), "l_suppkey"))


@query("""with o as (select distinct o_orderkey as k from orders where o_orderkey % 3 <> 0), l as (select distinct l_orderkey as k from lineitem where l_orderkey % 5 <> 0)
    select (select count(*) from (select k from o intersect select k from l))::bigint as "both", (select count(*) from (select k from o except select k from l))::bigint as only_left, (select count(*) from (select k from l except select k from o))::bigint as only_right""")
def set_correspondence(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"))
    return references.correspondence(o, _t(spark, sf_dir, "lineitem").filter("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("k")), "k")


@query("select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as k from orders) where k = 1")
def latest_manifest(spark, sf_dir):
    return references.latest(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


# ---- claims

_CLASSES = ["file_presence", "parse_success", "compile_validity", "doc_parity", "artifact_extraction_ready", "coverage_gap", "test_presence"]
_SYSTEMS = ["crawler", "artifacts", "verifier", "compiler", "governance"]
_POLARITY = {0: "supports", 1: "refutes", 2: "supports", 3: "unavailable", 4: "supports"}


def _observations(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    i = F.col("event_id")
    return e.select(
        (F.col("user_id") % 7).alias("repository"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string"))).alias("revision"), F.concat(F.lit("file:"), F.col("user_id").cast("string")).alias("target"),
        pick(_CLASSES, F.floor(i / 5)).alias("claim_class"), pick(_SYSTEMS, i).alias("subsystem"), pick(list(_POLARITY.values()), F.floor(i / 3)).alias("polarity"),
        F.least(F.lit(1.0), F.floor(F.abs("value") * 50) / 1000).alias("strength"), pick(list(FRESHNESS), F.floor(i / 2)).alias("freshness"), pick(["ready", "partial_success", "stale", "odd"], i).alias("health"), i.alias("observation_id"),
    )


def _pick(values, k: str) -> str:
    return f"([{', '.join(map(repr, values))}])[({k}) % {len(values)} + 1]"


_OBS = f"""
    auth(s, c, v) as (values {_values((s, c, v) for s, cs in AUTHORITY.items() for c, v in cs.items())}),
    wt(c, wa, we, wf, wg, wc, need) as (values {_values((c, *w) for c, w in WEIGHTS.items())}), fr(f, fv) as (values {_values(FRESHNESS.items())}), he(h, hv) as (values {_values(HEALTH.items())}),
    obs as (select user_id % 7 as repository, case when user_id % 3 > 0 then 'r' || user_id % 3 end as revision, 'file:' || user_id as target, {_pick(_CLASSES, "event_id // 5")} as claim_class, {_pick(_SYSTEMS, "event_id")} as subsystem,
        {_pick(list(_POLARITY.values()), "event_id // 3")} as polarity, least(1.0::double, floor(abs(value) * 50)::double / 1000::double) as strength, {_pick(list(FRESHNESS), "event_id // 2")} as freshness, {_pick(["ready", "partial_success", "stale", "odd"], "event_id")} as health, event_id as observation_id from events),
    ob as (select obs.*, coalesce(a.v, b.v, 0.0) as authority, coalesce(wa, {DEFAULT_WEIGHTS[0]}) as wa, coalesce(we, {DEFAULT_WEIGHTS[1]}) as we, coalesce(wf, {DEFAULT_WEIGHTS[2]}) as wf, coalesce(wg, {DEFAULT_WEIGHTS[3]}) as wg, coalesce(wc, {DEFAULT_WEIGHTS[4]}) as wc, need, coalesce(fv, 0.5) as fv, coalesce(hv, 0.5) as hv
        from obs left join auth a on a.s = subsystem and a.c = claim_class left join auth b on b.s = subsystem and b.c = '*' left join wt on wt.c = claim_class left join fr on f = freshness left join he on h = health),
    pr as (select x.observation_id, count(*) filter (y.polarity = x.polarity and y.subsystem <> x.subsystem) as same,
        count(*) filter (y.subsystem <> x.subsystem and case x.polarity when 'supports' then y.polarity = 'refutes' when 'refutes' then y.polarity = 'supports' else y.polarity in ('supports', 'refutes') end) as opposed,
        coalesce(max(y.authority) filter (x.polarity in ('supports', 'refutes') and y.polarity in ('supports', 'refutes') and y.polarity <> x.polarity), 0.0) as contradiction
        from ob x join ob y on x.repository = y.repository and x.revision is not distinct from y.revision and x.target = y.target and x.claim_class = y.claim_class group by x.observation_id),
    sc as (select ob.*, case when same + opposed > 0 then (same - opposed)::double / (same + opposed) else 0.0 end as agreement, contradiction from ob join pr using (observation_id)),
    mi as (select *, cast(round(greatest(0.0, wa::double * authority::double + we::double * strength + wf::double * fv::double + wg::double * agreement - wc::double * contradiction::double) * hv::double * 1000) as bigint) as milli from sc)"""


@query(f"with {_OBS} select observation_id, authority::double as authority, round(agreement, 6) as agreement, contradiction::double as contradiction, milli from mi")
def claim_scores(spark, sf_dir):
    s = claims.score_observations(_observations(spark, sf_dir))
    return s.select("observation_id", "authority", F.round("agreement", 6).alias("agreement"), "contradiction", "milli")


@query(f"""
    with {_OBS},
    g as (select repository, revision, target, claim_class, count(*) as n, sum(case when polarity = 'supports' then milli else 0 end) as support, sum(case when polarity = 'refutes' then milli else 0 end) as refute, any_value(need) as need, greatest(0.0, max(authority))::double as authority_score, greatest(0.0, max(strength))::double as evidence_score, greatest(0.0, max(fv))::double as freshness_score,
        bool_or(subsystem = need) as rp, coalesce(bool_or(subsystem = need and polarity = 'supports'), false) as rs, bool_and(polarity in ('unavailable', 'not_run')) as au,
        bool_or(claim_class = 'compile_validity' and subsystem = 'compiler' and polarity = 'refutes') as cr, bool_or(claim_class = 'doc_parity' and subsystem = 'governance' and polarity = 'refutes') as dr,
        bool_or(claim_class = 'artifact_extraction_ready' and subsystem = 'artifacts' and polarity in ('refutes', 'unavailable')) as ad, bool_or(polarity = 'supports' and freshness = 'stale') and not bool_or(polarity = 'supports' and freshness = 'fresh') as so,
        bool_or(polarity = 'supports' and authority >= 0.9 and milli > 0) and bool_or(polarity = 'refutes' and authority >= 0.9 and milli > 0) as cf,
        case when bool_or(freshness = 'fresh') then 'fresh' when bool_or(freshness = 'historical') then 'historical' when bool_or(freshness = 'stale') then 'stale' else 'unknown' end as freshness_posture,
        array_to_string(list_sort(list(distinct subsystem)), ',') as systems from mi group by all),
    d as (select *, printf('%.3f', support / 1000.0) as ss, printf('%.3f', refute / 1000.0) as rr,
        case when au then 'missing_required_evidence/none/lane_unavailability_conflict' when (cr or dr or ad) and claim_class = 'doc_parity' then 'policy_mismatch/high/doc_vs_code_mismatch'
        when cr or dr or ad then 'contradicted/high/' || case claim_class when 'compile_validity' then 'compile_vs_parse_disagreement' when 'artifact_extraction_ready' then 'lane_unavailability_conflict' else 'rule_conflict' end
        when so and claim_class = 'artifact_extraction_ready' then 'residual_stale_artifact/medium/artifact_vs_repo_staleness' when so then 'stale/medium/freshness_conflict' when support > 0 and need is not null and not rs then 'operator_review_required/low/missing_in_verifier'
        when support > 350 and refute > 350 and cf then 'authority_conflict/medium/rule_conflict' when support > 350 and refute > 350 then 'disputed/medium/rule_conflict' when refute >= 550 and refute > support then 'contradicted/high/rule_conflict'
        when support >= 780 then 'confirmed/high/' when support >= 600 then 'strong_support/medium_high/' when support >= 420 then 'moderate_support/medium/' when support > 0 then 'operator_review_required/low/coverage_shortfall' else 'coverage_gap/none/coverage_shortfall' end as r,
        case when au then 'no runnable subsystem produced claim evidence' when cr or dr or ad then 'hard gate failed before weighting' when so then 'supporting evidence is stale and no fresh support is present'
        when support > 0 and need is not null and not rs then 'support exists, but the claim-critical authority is missing' when support > 350 and refute > 350 then 'support (' || ss || ') and refutation (' || rr || ') both exceed dispute threshold'
        when refute >= 550 and refute > support then 'refutation score ' || rr || ' exceeds support ' || ss when support >= 780 then 'weighted support ' || ss || ' confirms the claim' when support >= 600 then 'weighted support ' || ss || ' strongly supports the claim'
        when support >= 420 then 'weighted support ' || ss || ' moderately supports the claim' when support > 0 then 'weighted support ' || ss || ' is below disposition threshold' else 'no supporting evidence reached the scoring threshold' end as rationale,
        concat_ws(',', 'identity_binding:gate_pass', case when need is not null then 'required_authority_presence:' || case when rp then 'gate_pass' else 'gate_unverifiable' end end, case when au then 'all_sources_unavailable:gate_unverifiable' end,
            case when cr then 'compiler_truth_refutation:gate_fail' end, case when dr then 'doc_parity_refutation:gate_fail' end, case when ad then 'artifact_denial:gate_fail' end, case when so then 'stale_support_only:gate_conflict' end) as gates from g)
    select repository, revision, target, claim_class, n::bigint as n, support::bigint as support, refute::bigint as refute, authority_score, evidence_score, freshness_score, gates, string_split(r, '/')[1] as disposition, string_split(r, '/')[2] as band, nullif(string_split(r, '/')[3], '') as mismatch, rationale, case when so and not au and not cr and not dr and not ad then 'stale' else freshness_posture end as freshness_posture, systems from d""")
def claim_decisions(spark, sf_dir):
    return claims.decide(claims.score_observations(_observations(spark, sf_dir))).drop("observation_ids")


@query(f"""with f as (select p_partkey, 'p' || p_partkey as path, case p_partkey % 4 when 0 then 'parsed' when 1 then 'parse_error' when 2 then 'deleted' else 'unsupported' end as st from part)
    select target, claim_class, polarity, round(strength, 3) as strength from (
        select 'file:' || path as target, 'file_presence' as claim_class, case when st = 'deleted' then 'refutes' else 'supports' end as polarity, 0.9::double as strength from f
        union all select 'file:' || path, 'file_deleted', 'supports', 0.9 from f where st = 'deleted' union all select 'file:' || path, 'file_hash', 'supports', 0.95 from f where st <> 'deleted' and p_partkey % 3 > 0
        union all select 'file:' || path, 'parse_success', case when st = 'parsed' then 'supports' else 'refutes' end, 0.85 from f where st in ('parsed', 'parse_error'))""")
def file_observations(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("parsed", "parse_error", "deleted", "unsupported"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = _t(spark, sf_dir, "part").select(F.lit("r").alias("repository"), F.lit(None).cast("string").alias("revision"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), status.alias("status"), F.when(F.col("p_partkey") % 3 > 0, "h").alias("sha256"))
    return claims.file_observations(files).select("target", "claim_class", "polarity", F.round("strength", 3).alias("strength"))


# ---- queues

_KINDS = ["claim", "heartbeat", "heartbeat", "complete", "fail", "reclaim", "claim"]


def _events(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") * 31 % 7 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), "event_id", kind.alias("kind"), F.concat(F.lit("w"), (F.col("event_id") % 5).cast("string")).alias("actor"), F.unix_timestamp("ts").alias("at"))


_QUEUE = f"""
    q as (select user_id as item_id, event_id, {_pick(_KINDS, "event_id * 31")} as kind, 'w' || event_id % 5 as actor, epoch(date_trunc('second', ts))::bigint as tm from events),
    s as (select * from (select *, sum(case when kind = 'claim' then 1 else 0 end) over (partition by item_id order by tm, event_id rows unbounded preceding) as attempt from q) where attempt > 0),
    l as (select *, not coalesce(bool_or(kind in ('complete', 'fail', 'reclaim')) over (partition by item_id, attempt order by tm, event_id rows between unbounded preceding and 1 preceding), false) as live from s),
    ep as (select item_id, attempt, min(tm) filter (kind = 'claim') as claimed_at, arg_min(actor, tm) filter (kind = 'claim') as claimant, count(*) filter (kind = 'heartbeat' and live) as heartbeats, max(tm) filter (kind = 'heartbeat' and live) as last_heartbeat,
        case when count(*) filter (kind = 'complete' and live) > 0 then 'completed' when count(*) filter (kind = 'fail' and live) > 0 then 'failed' when count(*) filter (kind = 'reclaim' and live) > 0 then 'reclaimed' else 'active' end as state from l group by item_id, attempt)"""


@query(f"with {_QUEUE} select item_id, attempt::bigint as attempt, claimed_at, claimant, heartbeats::bigint as heartbeats, last_heartbeat, state from ep")
def claim_episodes(spark, sf_dir):
    e = queue.episodes(_events(spark, sf_dir))
    return e.select("item_id", F.col("attempt").cast("long").alias("attempt"), "claimed_at", "claimant", "heartbeats", "last_heartbeat", "state")


@query(f"""
    with {_QUEUE}, i as (select distinct user_id as item_id from events), t as (select item_id, max(attempt) as attempts, arg_max(state, attempt) as st from ep group by item_id)
    select item_id, coalesce(attempts, 0)::bigint as attempts, case when st in ('completed', 'failed') then st when st = 'active' then 'claimed' else 'queued' end as status from i left join t using (item_id)""")
def item_states(spark, sf_dir):
    e = _events(spark, sf_dir)
    return queue.item_states(e.select("item_id").distinct(), queue.episodes(e)).select("item_id", F.col("attempts").cast("long").alias("attempts"), "status")


@query(f"""
    with {_QUEUE} select item_id, attempt::bigint as attempt, case when last_heartbeat is not null and item_id % 2 = 0 then last_heartbeat + 600 else claimed_at + 3600 end as expiry, case when last_heartbeat is not null and item_id % 2 = 0 then 'heartbeat' else 'claim' end as expiry_source
    from ep where state = 'active' and case when last_heartbeat is not null and item_id % 2 = 0 then last_heartbeat + 600 else claimed_at + 3600 end <= (select max(tm) from q) - 86400""")
def lease_expiry(spark, sf_dir):
    e = _events(spark, sf_dir)
    now = e.agg(F.max("at") - 86400).first()[0]
    x = queue.expired(queue.episodes(e), F.lit(now), F.when(F.col("item_id") % 2 == 0, F.lit(600)), F.lit(3600))
    return x.select("item_id", F.col("attempt").cast("long").alias("attempt"), F.col("expiry").cast("long").alias("expiry"), "expiry_source")


@query(f"""
    with {_QUEUE}, i as (select distinct user_id as item_id, user_id % 3 as blocking from events), t as (select item_id, max(attempt) as attempts, arg_max(state, attempt) as st from ep group by item_id),
    st as (select case when st in ('completed', 'failed') then st when st = 'active' then 'claimed' else 'queued' end as status, blocking from i left join t using (item_id)),
    x as (select state, attempt = attempts as last, blocking from ep join i using (item_id) join t using (item_id)),
    o(s, k) as (values ('completed', 'completion'), ('failed', 'failure'), ('reclaimed', 'reclaim')),
    r as (select 'item' as kind, status as key, blocking from st union all select 'episode', state, blocking from x union all select 'claim', state, blocking from x where last union all select k, 'all', blocking from x join o on s = state)
    select kind, key, count(*)::bigint as n, sum(blocking)::bigint as blocking from r group by kind, key""")
def queue_report(spark, sf_dir):
    e = _events(spark, sf_dir)
    ep = queue.episodes(e)
    return queue.report(queue.item_states(e.select("item_id", (F.col("item_id") % 3).alias("blocking")).distinct(), ep), ep)


@query(f"""
    with {_QUEUE}, i as (select distinct user_id as item_id from events), t as (select item_id, arg_max(state, attempt) as st from ep group by item_id)
    select item_id from i left join t using (item_id) where coalesce(st, 'reclaimed') = 'reclaimed' order by item_id limit 5""")
def next_items(spark, sf_dir):
    e = _events(spark, sf_dir)
    return queue.next_items(queue.item_states(e.select("item_id").distinct(), queue.episodes(e)), 5).select("item_id")


@query("select user_id as item_id, case when user_id % 4 = 0 then 'already_present' else 'enqueued' end as result from (select distinct user_id from events)")
def enqueue_dedupe(spark, sf_dir):
    items = _t(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"))
    return queue.enqueue(items, items.filter("item_id % 4 = 0")).select("item_id", "result")


@query("select distinct unnest(json_keys(props)) as key from events")
def schema_keys(spark, sf_dir):
    return queue.schema_keys(_t(spark, sf_dir, "events"), "props")


# ---- time


@query("""
    with w as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 1800000000 then 0 else 1 end as start from events),
    s as (select *, sum(start) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from w)
    select user_id, session::bigint as session, min(ts) as first, max(ts) as last, count(*)::bigint as n from s group by user_id, session""")
def watch_sessions(spark, sf_dir):
    return sessions(_t(spark, sf_dir, "events"), "user_id", "ts", 1800, "event_id")


@query("""
    with w as (select user_id, epoch(date_trunc('second', ts))::bigint as tm, event_id from events), f as (select distinct user_id, tm from w),
    n as (select user_id, tm, coalesce(lead(tm) over (partition by user_id order by tm) - 1, (select max(tm) from w)) as till from f)
    select user_id, unnest(range(tm + 86400, till + 1, 86400)) as at from n""")
def watch_reconciles(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("at"))
    return reconciles(e.distinct(), "user_id", "at", 86400, F.lit(e.agg(F.max("at")).first()[0]))


@query("""select c_custkey, case when a is null or s is null then 'unavailable' when a >= s then 'supports' else 'refutes' end as polarity from (
    select c_custkey, max(o_orderdate) filter (o_orderstatus = 'F') as a, max(o_orderdate) filter (o_orderstatus = 'O') as s from customer left join orders on o_custkey = c_custkey group by c_custkey)""")
def doc_parity(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("a"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).alias("s"))
    return _t(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", parity(F.col("a"), F.col("s")).alias("polarity"))
