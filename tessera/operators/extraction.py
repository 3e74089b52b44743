"""Text to blocks, sections and chunks, one row a document and without any exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import artifact_id, chunk_id, heading_level, heading_title, is_table_line, let, lines, package_id, source_hash, strip
from ..functions.vocabulary import LANES, MAX_BLOCK_CHARS, MAX_HEADING_CHARS, PACKAGE_TTL_SECONDS


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: filters above aren't pushed into them, nor are they inlined in what uses them."""
    return df.select("*", F.explode_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__once")).select(*df.columns, "__once.*")


def blocks(text: Column, headings: bool) -> Column:
    """WIN-02, WIN-04, STR-02: array<struct<pos, kind, text, level>>; lines without a blank line between them are one paragraph.

    Headings are set apart with blank lines, so that the text falls into blocks at runs of blank lines: linear, with no
    window over lines.
    """
    trimmed = F.transform(lines(text), strip)
    if headings:
        trimmed = F.transform(trimmed, lambda t: F.when(heading_level(t).isNotNull(), F.concat(F.lit("\n"), t, F.lit("\n"))).otherwise(t))
    parts = F.filter(F.split(F.array_join(trimmed, "\n"), "\n{2,}"), lambda b: F.btrim(b, F.lit("\n")) != "")
    parts = F.transform(parts, lambda b: F.btrim(b, F.lit("\n")))

    def one(b: Column, pos: Column) -> Column:
        level = heading_level(b) if headings else F.lit(None).cast("int")
        title = F.when(level.isNotNull(), heading_title(b)).otherwise(b)
        return F.struct(pos.alias("pos"), F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("kind"), title.alias("text"), level.alias("level"))

    return F.transform(parts, one)


def sections(found: Column) -> Column:
    """WIN-01: array<struct<section, heading, level, block_count, start>>: each heading up to the next.

    start is where a section's chunk is sliced from: counts add up from block 0, so text before the first heading
    shifts every chunk to the left.
    """
    heads = F.filter(found, lambda b: b["kind"] == "heading")

    def all_of(hs: Column) -> Column:
        return F.transform(
            hs,
            lambda h, i: F.struct(
                (i + 1).alias("section"),
                h["text"].alias("heading"),
                h["level"].alias("level"),
                F.greatest(F.lit(1), F.coalesce(F.get(hs, i + 1)["pos"], F.size(found)) - h["pos"]).alias("block_count"),
                (h["pos"] - F.get(hs, F.lit(0))["pos"]).alias("start"),
            ),
        )

    return let(heads, all_of)


def extract(docs: DataFrame, request_id: Column, source_ref: Column, headings: bool = True) -> DataFrame:
    """SRC-02, UDF-01, PRED-05, STR-33: docs with blocks, sections, tables_detected, artifact_id, source_hash, state and reason.

    An empty text is denied as unsupported_source_type; a heading or block beyond the limits as ineligible_source.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = once(docs, blocks=blocks(text, headings), tables_detected=F.size(F.filter(lines(text), is_table_line)))
    out = once(out.withColumns({"request_id": request_id, "source_ref": source_ref}), sections=sections(F.col("blocks")))
    too_long = F.exists("blocks", lambda b: F.when(b["kind"] == "heading", F.length(b["text"]) > MAX_HEADING_CHARS).otherwise(F.length(b["text"]) > MAX_BLOCK_CHARS))
    out = once(out, reason=F.when(F.size("blocks") == 0, "unsupported_source_type").when(too_long, "ineligible_source"))
    out = out.withColumn("state", F.when(F.col("reason").isNull(), "ready").otherwise("denied"))
    return out.withColumns({"artifact_id": artifact_id(F.col("request_id"), F.col("source_ref")), "source_hash": source_hash(text)})


def packages(extracted: DataFrame) -> DataFrame:
    """PRED-06, WIN-06, WIN-07, STR-10, STM-17, UDF-02: extracted with mode, chunks, package_id, package_state and package_reason.

    Only ready extractions are packaged. Documents with sections get one chunk a section, others one a paragraph; no
    chunk, or one beyond the limit, refuses the whole package.
    """
    section = F.transform("sections", lambda s: F.struct(F.lit("section").alias("kind"), F.array_join(F.transform(F.slice("blocks", s["start"] + 1, s["block_count"]), lambda b: b["text"]), "\n\n").alias("text")))
    paragraph = F.transform(F.filter("blocks", lambda b: b["kind"] == "paragraph"), lambda b: F.struct(F.lit("paragraph").alias("kind"), b["text"].alias("text")))
    raw = F.when(F.size("sections") > 0, section).otherwise(paragraph)
    numbered = F.transform(raw, lambda c, i: F.struct(i.alias("ordinal"), c["kind"].alias("kind"), c["text"].alias("text"), chunk_id(F.col("request_id"), F.col("source_ref"), i, c["kind"]).alias("chunk_id")))
    out = once(extracted.withColumn("mode", F.when(F.size("sections") > 0, "section").otherwise("paragraph")), all_chunks=numbered)
    bad = F.exists("all_chunks", lambda c: (c["text"] == "") | (F.length(c["text"]) > MAX_BLOCK_CHARS))
    reason = F.when(F.col("state") == "stale", "stale_extraction").when(F.col("state") != "ready", "ineligible_extraction").when((F.size("all_chunks") == 0) | bad, "unsupported_route")
    out = once(out, package_reason=reason)
    out = out.withColumns({"package_state": F.when(F.col("package_reason").isNull(), "ready").otherwise("denied"), "chunks": F.when(F.col("package_reason").isNull(), F.col("all_chunks")), "package_id": package_id(F.col("request_id"), F.col("source_ref"))})
    return out.withColumn("ttl_seconds", F.lit(PACKAGE_TTL_SECONDS)).drop("all_chunks")


def page_blocks(text: Column) -> Column:
    """SRC-03, WIN-03: blocks of a text layer, page by page: pages end at form feeds, and no block crosses one."""
    pages = F.filter(F.transform(F.split(text, "\f"), lambda p, i: F.struct((i + 1).alias("page"), blocks(p, False).alias("blocks"))), lambda p: F.size(p["blocks"]) > 0)
    return F.flatten(F.transform(pages, lambda p: F.transform(p["blocks"], lambda b: F.struct(p["page"].alias("page"), b["text"].alias("text")))))


def admit(sources: DataFrame, available: tuple[str, ...] = tuple(lane for lane, *_ in LANES)) -> DataFrame:
    """PRED-01, PRED-02: sources (path, media_type) with lane, worker, admitted, failure_state and reason; the first failing rule decides.

    The suffix is compared in lower case, a declared media type must be one of the lane's, and a lane whose tools are
    missing (not in available) is unavailable. Lanes are seven literal rows.
    """
    suffix = F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1))
    lane = F.coalesce(*[F.when(suffix == end, F.struct(F.lit(name).alias("lane"), F.array(*map(F.lit, media)).alias("media"), F.lit(worker).alias("worker"))) for name, end, media, worker in LANES])
    out = sources.withColumn("__lane", lane)
    wrong = F.col("media_type").isNotNull() & ~F.array_contains("__lane.media", F.col("media_type"))
    state = F.when(F.col("__lane").isNull() | wrong, "denied").when(~F.col("__lane.lane").isin(*available), "unavailable")
    reason = F.when(F.col("__lane").isNull() | wrong, "unsupported_source_type").when(~F.col("__lane.lane").isin(*available), "dependency_unavailable")
    out = out.withColumns({"lane": F.col("__lane.lane"), "worker": F.col("__lane.worker"), "failure_state": state, "reason": reason})
    return out.withColumn("admitted", F.col("reason").isNull()).drop("__lane")


def intake_errors(payloads: DataFrame, rules: list[tuple[str, Column, str]], most: int = 10) -> DataFrame:
    """PRED-04, UDF-36, WIN-18: payloads with errors (path, message), in order and at most `most`, and error_count, the true one.

    rules: path, what must hold, message. They become one projection; nothing is joined.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for path, ok, message in rules]))
    return payloads.withColumn("__all", F.array_sort(broken)).withColumns({"errors": F.slice("__all", 1, most), "error_count": F.size("__all"), "valid": F.size("__all") == 0}).drop("__all")
