"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import digest_conversations, format_turns
from .common import crc32_mod, table
from .embedding_dedup import embedding_groups
from .langid import fit_languages, identify
from .mixing import mix_documents
from .packing import pack_documents
from .quality import STOP_WORDS, quality
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .token_output import read_token_files, write_token_files

from .toxicity import toxicity


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest_conversations(format_turns(turns.union(more)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), vocabulary(), 2))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*cols)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_formatting, op2_substring_dedup, op3_best_fit_packing, op4_simhash_near_dedup, op5_token_output, op6_source_mixing, op7_language_id, op8_quality_rules, op9_toxicity, op10_embedding_near_dedup)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '<turn>', '\lturn>'), '</turn>', '\l/turn>')"

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": rf"""
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
        select conv_id, count(*)::bigint as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
            sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
            sum(15 + length(replace({_ESCAPED.format("role")}, chr(10), '\n')) + length({_ESCAPED.format("text")}))::bigint as formatted_chars
        from rows group by conv_id""",
    "op2_substring_dedup": f"""
        with w as (select row_number() over () as rid, doc_id, {_WORDS} as ws from documents),
        win as (select rid, i, md5(array_to_string(ws[i:i+34], ' ')) as h from (select rid, ws, unnest(range(1, len(ws) - 33)) as i from w)),
        dup as (select h from win group by h having count(*) > 1),
        cov as (select distinct rid, i + j as p from win join dup using (h), range(35) as r(j)),
        words as (select rid, p, ws[p] as word from (select rid, ws, unnest(range(1, len(ws) + 1)) as p from w)),
        kept as (select rid, string_agg(word, ' ' order by p) as k, count(*) as n from words anti join cov using (rid, p) group by rid)
        select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
        from w left join kept using (rid)""",
    "op8_quality_rules": rf"""
        with w as (
            select row_number() over () as rid, doc_id, coalesce(text, '') as t, {_WORDS} as ws,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
        win as (select rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as g from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
        often as (select rid, i, count(*) over (partition by rid, g) as c from win),
        cov as (select rid, count(distinct i + j) as n from often, range(3) as r(j) where c > 1 group by rid),
        m as (
            select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
                (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(ls) as n_lines,
                len(list_filter(ws, lambda x: lower(x) in ({", ".join(repr(x) for x in sorted(set(STOP_WORDS)))}))) as n_stop,
                len(list_filter(ws, lambda x: x[-2:] = '!!')) as n_bang
            from w left join cov using (rid))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
            not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
                and word_chars / n_words between 2 and 15 and n_symbols / n_words <= 0.25 and n_stop / n_words >= 0.005
                and coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 and n_bang / n_words <= 0.5 and n_repeat_words / n_words <= 0.5 as kept
        from m""",
    "op10_embedding_near_dedup": """
        with recursive v as (
            select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings),
        ok as (select * from v where label is not null and e is not null and len(e) > 0
            and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
        links as (select a.r, a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
            where list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) as (select vec_id, vec_id from v union select reach.a, links.b from reach join links on reach.b = links.a)
        select v.vec_id, (select count(*) from links where links.r = v.r)::bigint as n_links,
            (select min(b) from reach where reach.a = v.vec_id) as component_id,
            v.vec_id = (select min(b) from reach where reach.a = v.vec_id) as kept
        from v""",
}
