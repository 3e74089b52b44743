"""Queries for operators that no other query calls: containers, file policies, lookups, totals, reads and small functions."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import text as T
from ..functions.vocabulary import AUTHORITY, DEFAULT_WEIGHTS, EXCLUDED_DIRS, WEIGHTS
from ..operators import claims, crawl, index, queue, references, runs, service
from ..sources.containers import container_blocks
from .queries import _PATHS, _paths, _t, _values, query

_LANES = ("docx_text", "odt_text", "epub_text")


@F.pandas_udf(BinaryType())
def _package(lane: pd.Series, text: pd.Series) -> pd.Series:
    """A file of its lane with a paragraph for each line (the query's input, not an operator)."""
    from xml.sax.saxutils import escape

    def one(kind: str, lines: list[str]) -> bytes:
        p = [escape(x) for x in lines]
        if kind == "docx_text":
            members = {"word/document.xml": "<w:document xmlns:w='urn:w'><w:body>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in p) + "</w:body></w:document>"}
        elif kind == "odt_text":
            members = {"content.xml": "<d><body><text>" + "".join(f"<p>{x}</p>" for x in p) + "</text></body></d>"}
        else:
            members = {
                "mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="p.opf"/></c>', "a.xhtml": "<html><body>" + "".join(f"<p>{x}</p>" for x in p) + "</body></html>",
                "p.opf": '<package><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>',
            }
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in members.items():
                z.writestr(name, body)
        return out.getvalue()

    return pd.Series([one(k, (t or "").split("\n")) for k, t in zip(lane, text, strict=True)])


@query(f"""
    with d as (select doc_id, ([{", ".join(map(repr, _LANES))}])[doc_id % 3 + 1] as lane, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{{A0}}\\x{{85}}]+', ' ', 'g'))), lambda x: x <> '') as ls from documents),
    k as (select doc_id, lane, case when len(list_filter(ls, lambda x: length(x) > 20000)) > 0 then [] else ls end as ls from d),
    r as (select doc_id, lane, case when len(ls) = 0 then 'denied' else 'ready' end as state, unnest(case when len(ls) = 0 then [null] else ls end) as t, unnest(range(0, greatest(len(ls), 1))) as pos from k)
    select doc_id, lane, state, case when state = 'ready' then pos end::bigint as pos, sha256(t) as text_sha256 from r""")
def package_blocks(spark, sf_dir):
    """Each document as DOCX, ODT or EPUB in turn, and its blocks; a block above 20 000 characters denies the file."""
    lane = F.element_at(F.array(*map(F.lit, _LANES)), (F.col("doc_id") % 3 + 1).cast("int"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x08\\x0B-\\x1F]", "")
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), lane.alias("lane"), _package(lane, plain).alias("content"))
    b = container_blocks(files).select("path", "lane", "state", F.explode_outer("blocks").alias("b"))
    return b.select(F.col("path").cast("long").alias("doc_id"), "lane", "state", F.col("b.pos").cast("long").alias("pos"), F.sha2("b.text", 256).alias("text_sha256"))


@query(f"""
    with {_PATHS}
    select p_partkey, list_filter(string_split(lower(path), '/'), lambda x: x in ({", ".join(map(repr, EXCLUDED_DIRS))}))[1] as excluded, bin as is_binary, path = 'web' or starts_with(path, 'web/') or path = 'docs/a.MD' as in_targets from f""")
def file_policies(spark, sf_dir):
    f = _paths(spark, sf_dir)
    content = F.encode(F.when(F.col("binary"), F.concat(F.lit("ab\0c"), "path")).otherwise(F.col("path")), "UTF-8")
    hit = crawl.in_targets(f, ["web/", "docs/a.MD"]).select("p_partkey", F.lit(True).alias("hit"))
    return f.join(hit, "p_partkey", "left").select("p_partkey", crawl.skip_dir(F.col("path")).alias("excluded"), crawl.is_binary(content).alias("is_binary"), F.coalesce("hit", F.lit(False)).alias("in_targets"))


_VALUES = ["^1.2/3", "~4/5", "1.2.3", "owner/repo", "https://github.com/a/b", "git@github.com:a/b", "git+ssh://x/y", "plain", " spaced/name ", "v/"]


@query(f"""
    with v as (select p_partkey, trim(([{", ".join(map(repr, _VALUES))}])[p_partkey % {len(_VALUES)} + 1]) as v from part)
    select p_partkey, contains(v, 'github.com/') or starts_with(v, 'git@github.com:') or starts_with(v, 'git+ssh://') or (contains(v, '/') and not regexp_matches(v, '^[~^]') and not regexp_full_match(v, '[0-9.]*')) as is_repo from v""")
def repo_references(spark, sf_dir):
    v = F.element_at(F.array(*map(F.lit, _VALUES)), (F.col("p_partkey") % len(_VALUES) + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", references.is_repo_reference(v).alias("is_repo"))


_PAIRS = [(s, c) for s in ("crawler", "artifacts", "verifier", "compiler", "governance", "nobody") for c in ("file_presence", "compile_validity", "doc_parity", "odd_class")]


@query(f"""
    with p(k, s, c) as (values {_values((k, s, c) for k, (s, c) in enumerate(_PAIRS))}), a(s, c, v) as (values {_values((s, c, v) for s, cs in AUTHORITY.items() for c, v in cs.items())}),
    w(c, w0, w1, w2, w3, w4, need) as (values {_values((c, *w) for c, w in WEIGHTS.items())}), e as (select event_id, event_id % {len(_PAIRS)} as k, value from events)
    select event_id, coalesce(x.v, y.v, 0.0)::double as authority, coalesce(w0, {DEFAULT_WEIGHTS[0]})::double as first_weight, coalesce(w4, {DEFAULT_WEIGHTS[4]})::double as last_weight,
        case when event_id % 3 = 0 then least(1.0, greatest(0.0, value / 10)) when event_id % 3 = 1 then least(1.0, greatest(0.5, value / 10, value / 100)) else 0.5 end::double as strength
    from e join p using (k) left join a x on x.s = p.s and x.c = p.c left join a y on y.s = p.s and y.c = '*' left join w on w.c = p.c""")
def claim_lookups(spark, sf_dir):
    k = (F.col("event_id") % len(_PAIRS) + 1).cast("int")
    s, c = (F.element_at(F.array(*[F.lit(p[i]) for p in _PAIRS]), k) for i in (0, 1))
    third = F.col("event_id") % 3
    evidence = F.when(third == 1, F.array(F.col("value") / 10, F.col("value") / 100))
    strength = claims.evidence_strength(F.when(third == 0, F.col("value") / 10), evidence)
    return _t(spark, sf_dir, "events").select("event_id", claims.authority(s, c).alias("authority"), claims.weight(c, 0).alias("first_weight"), claims.weight(c, 4).alias("last_weight"), strength.cast("double").alias("strength"))


@query("""
    select page_id, len(list_filter(string_split(html, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2))::bigint as table_lines,
        len(list_filter(string_split(replace(html, '>', '|'), chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2))::bigint as marked_lines from pages""")
def table_line_counts(spark, sf_dir):
    n = lambda c: F.size(F.filter(F.split(c, "\n", -1), T.is_table_line)).cast("long")
    return _t(spark, sf_dir, "pages").select("page_id", n(F.col("html")).alias("table_lines"), n(F.replace("html", F.lit(">"), F.lit("|"))).alias("marked_lines"))


@query("""
    select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'blocking' when o_orderpriority = '3-MEDIUM' then 'strong' else 'supporting' end as weight,
        case when o_totalprice < 50000 then 0 when o_totalprice > 150000 then 1 else (o_totalprice - 50000) / 100000 end::double as clamped, o_orderkey % 5 in (0, 1) as filled from orders""")
def small_functions(spark, sf_dir):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    said = F.element_at(F.array(*map(F.lit, ['{"a": 1}', "0", " [ ] ", "null", '""'])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.severity_weight(severity).alias("weight"), T.clamp((F.col("o_totalprice") - 50000) / 100000).alias("clamped"), service.is_filled(said).alias("filled"))


@query("select l_orderkey, l_linenumber, l_partkey, floor(abs(l_extendedprice * 0.001) * 1000 + 0.5) / 1000 * case when l_linenumber % 2 = 0 then 1 else -1 end as rounded from lineitem")
def rounded_scores(spark, sf_dir):
    x = F.col("l_extendedprice") * 0.001 * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", service.round3(x).alias("rounded"))


@query("select count(*)::bigint as items, sum(l_linenumber)::bigint as issues, (count(*) filter (l_returnflag = 'R'))::bigint as blocking from lineitem")
def queue_totals(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("issues"), (F.col("l_returnflag") == "R").cast("long").alias("blocking"))
    return queue.totals(items)


@query("""
    select o_orderkey, case when o_orderkey % 7 = 0 then 'completed' when o_orderkey % 5 = 0 then 'failed' when o_orderkey % 3 = 0 then 'reclaimed' else 'active' end as state from orders""")
def claim_states(spark, sf_dir):
    at = lambda n: F.when(F.col("o_orderkey") % n == 0, F.lit(1))
    return _t(spark, sf_dir, "orders").select("o_orderkey", queue.claim_state(at(7), at(5), at(3)).alias("state"))


@query("""
    with c as (select o_orderkey, epoch(o_orderdate)::bigint as since, o_orderkey % 3 as m from orders where o_orderkey % 4 <> 1)
    select o_orderkey, case when m = 0 then since + 500 + 3600 else since + 86400 end::bigint as expiry, case when m = 0 then 'heartbeat' else 'claim' end as expiry_source from c where case when m = 0 then since + 500 + 3600 else since + 86400 end <= epoch(timestamp '1995-06-01')""")
def expired_leases(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    e = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 1, "completed").otherwise("active").alias("state"), at.alias("claimed_at"), F.when(F.col("o_orderkey") % 3 == 0, at + 500).alias("last_heartbeat"))
    now = F.unix_timestamp(F.lit("1995-06-01 00:00:00").cast("timestamp"))
    return queue.expired(e, now, F.lit(3600), F.lit(86400)).select("o_orderkey", F.col("expiry").cast("long").alias("expiry"), "expiry_source")


@query(f"""
    with {_PATHS}, g as (select p_partkey, path || '#' || p_partkey as path, ([{", ".join(map(repr, ("parsed", "parse_error", "deleted", "unsupported")))}])[p_partkey % 4 + 1] as status from f)
    select path, status, status <> 'deleted' as active from g where status in ('parsed', 'deleted')""")
def file_queries(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("parsed", "parse_error", "deleted", "unsupported"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = _paths(spark, sf_dir).select(F.concat_ws("#", "path", F.col("p_partkey").cast("string")).alias("path"), status.alias("status"), crawl.language(F.col("path")).alias("lang"))
    both = crawl.query_files(files, status="parsed").unionByName(crawl.query_files(files, status="deleted"))
    return both.select("path", "status", (F.col("status") != "deleted").alias("active"))


@query("select o_custkey as repo_id, c_name as name from orders join customer on c_custkey = o_custkey where o_orderkey % 100 = 7")
def scan_repositories(spark, sf_dir):
    scans = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("scan_id"), F.col("o_custkey").alias("repo_id"))
    return index.scan_repository(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("name")), scans, 7).select("repo_id", "name")


@query("select o_orderkey as decision_id, o_custkey as repository, o_orderpriority as disposition from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def find_decisions(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("repository"), F.col("o_orderstatus").alias("target"), F.col("o_orderpriority").alias("disposition"), F.col("o_orderdate").alias("run_id"))
    return index.find_decisions(d, target="F", disposition="1-URGENT").select("decision_id", "repository", "disposition")


@query("select (count(*) filter (doc_id % 3 = 0))::bigint as hits, (count(*) filter (doc_id % 3 <> 0))::bigint as misses from documents")
def cache_outcomes(spark, sf_dir):
    return runs.cache_outcome(_t(spark, sf_dir, "documents").select((F.col("doc_id") % 3 == 0).alias("hit")))


@query("select o_orderkey, (row_number() over (partition by o_custkey order by o_orderdate, o_orderkey))::bigint as attempt from orders where o_orderkey % 5 <> 0")
def claim_attempts(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 5 == 0, "heartbeat").otherwise("claim")
    ev = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), kind.alias("kind"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("event_id"), F.lit("a").alias("actor"))
    return queue.number_claims(ev).select(F.col("event_id").alias("o_orderkey"), F.col("attempt").cast("long").alias("attempt"))
