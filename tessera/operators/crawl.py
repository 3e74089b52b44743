"""Code and file trees: policy, languages, line facts, symbols, change detection, index tables."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import CODE_NEWLINE, clip, code_heading, let, lines, lookup, shell_function, squeeze, strip
from ..functions.vocabulary import COMMENT_STARTS, EXCLUDED_DIRS, EXCLUDED_EXTENSIONS, LANGUAGE_OF_EXTENSION, LANGUAGE_OF_NAME, LOCKFILES, MAX_CRAWL_BYTES
from ..plans.shared import cut

cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower case, without the dot; a name that is all dot and letters (.bashrc) has none."""
    return F.lower(F.regexp_extract(file_name(path), "^.+\\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """PRED-11: by file name, else by extension, else unknown."""
    return F.coalesce(lookup(F.lower(file_name(path)), LANGUAGE_OF_NAME), lookup(extension(path), LANGUAGE_OF_EXTENSION), F.lit("unknown"))


def skip_dir(path: Column, dirs: tuple[str, ...] = EXCLUDED_DIRS) -> Column:
    """PRED-07: the first excluded component, in lower case, or null."""
    return F.get(F.filter(F.split(F.lower(path), "/"), lambda p: p.isin(*dirs)), F.lit(0))


def is_binary(content: Column) -> Column:
    """PRED-09: a NUL among the first 8192 bytes."""
    return F.position(F.unhex(F.lit("00")), F.substring(content, 1, 8192)) > 0


def skip_reason(path: Column, size: Column, binary: Column, most: int = MAX_CRAWL_BYTES) -> Column:
    """PRED-08: why a file is skipped, the first that holds: directory, size, lockfile, extension, binary; null: it isn't."""
    found, ext = skip_dir(path), extension(path)
    return F.coalesce(
        F.when(found.isNotNull(), F.concat(F.lit("excluded_dir:"), found)),
        F.when(size > most, F.lit(f"size_limit:>{most}")),
        F.when(file_name(path).isin(*LOCKFILES), F.lit("generated_lockfile")),
        F.when(ext.isin(*EXCLUDED_EXTENSIONS), F.concat(F.lit("excluded_extension:"), ext)),
        F.when(binary, F.lit("binary_denied")),
    )


def in_targets(files: DataFrame, targets: list[str]) -> DataFrame:
    """PRED-10: files at or under one of the targets; no target passes all. Targets are literals, so this is a filter."""
    if not targets:
        return files
    hit = F.lit(False)
    for t in targets:
        hit = hit | (F.col("path") == t) | F.startswith(F.col("path"), F.lit(t.rstrip("/") + "/"))
    return files.filter(hit)


def contained(path: Column) -> Column:
    """PRED-23: the path with . and .. resolved, or null where it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("fine"))

    def step(a: Column, p: Column) -> Column:
        up = p == ".."
        at = F.when(up, F.slice(a["at"], 1, F.greatest(F.size(a["at"]) - 1, F.lit(0)))).otherwise(F.concat(a["at"], F.array(p)))
        return F.struct(at.alias("at"), (a["fine"] & (~up | (F.size(a["at"]) > 0))).alias("fine"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["fine"] & ~path.startswith("/"), F.array_join(a["at"], "/")))


def file_metrics(lang: Column, text: Column) -> Column:
    """AGG-13: total, blank, comment, todo and fixme lines of a text, as a struct."""
    families = {}
    for name, starts in COMMENT_STARTS.items():
        families.setdefault(starts, []).append(name)

    def comment(t: Column) -> Column:
        out = F.lit(False)
        for starts, names in families.items():
            out = out | (lang.isin(*names) & t.rlike("^(?:" + "|".join(x.replace("*", "\\*") for x in starts) + ")"))
        return out

    def count(ls: Column) -> Column:
        n = lambda p: F.size(F.filter(ls, p)).cast("long")
        has = lambda m: n(lambda x: F.contains(x, F.lit(m)))
        return F.struct(F.size(ls).cast("long").alias("total_lines"), n(lambda x: strip(x) == "").alias("blank_lines"), n(lambda x: comment(strip(x))).alias("comment_lines"), has("TODO").alias("todo_count"), has("FIXME").alias("fixme_count"))

    return let(lines(text, CODE_NEWLINE), count)


@F.pandas_udf(ArrayType(LongType()))
def _line_starts(text: pd.Series) -> pd.Series:
    """The byte at which each line of a text begins."""
    return text.map(lambda t: None if t is None else np.concatenate(([0], np.flatnonzero(np.frombuffer(t.encode(), np.uint8) == 10) + 1)))


def line_facts(files: DataFrame) -> DataFrame:
    """STR-41: files exploded to line_no (from 1), line and start_byte: the sum of bytes before, one a line end included.

    Offsets are found in one pass over a text's bytes, by Arrow batches, as a running sum within an array has no linear
    form in built-in functions; nothing is shuffled.
    """
    ls = F.split("text", "\n", -1)
    kept = [c for c in files.columns if c != "text"]
    zipped = files.select(*kept, F.posexplode(F.arrays_zip(ls.alias("line"), _line_starts("text").alias("start_byte"))).alias("k", "z"), F.size(ls).alias("n"))
    rows = zipped.filter("not (k = n - 1 and z.line = '')")
    return rows.select(*kept, (F.col("k") + 1).alias("line_no"), F.regexp_replace("z.line", "\\r$", "").alias("line"), "z.start_byte")


def symbols(facts: DataFrame) -> DataFrame:
    """STR-03, STR-39, STR-40, UDF-07, WIN-16: symbols of line facts: code headings, shell functions, TODO and FIXME markers."""
    head = code_heading(F.col("line"))
    row = lambda cond, kind, name: F.when(cond, F.struct(kind.alias("kind"), name.alias("name")))
    found = F.array_compact(
        F.array(
            row((F.col("lang") == "md") & head.isNotNull(), F.concat(F.lit("heading"), head["level"].cast("string")), head["title"]),
            row((F.col("lang") == "sh") & shell_function(F.col("line")).isNotNull(), F.lit("function"), shell_function(F.col("line"))),
            *[row(F.contains(F.col("line"), F.lit(m)), F.lit("marker"), F.lit(m)) for m in ("TODO", "FIXME")],
        )
    )
    kept = [c for c in facts.columns if c != "line"]
    return facts.select(*kept, F.explode(found).alias("s")).select(*kept, "s.*")


def include_edges(facts: DataFrame) -> DataFrame:
    """UDF-07, STR-07: what shell files include: lines that begin with `source ` or `. `."""
    t = strip(F.col("line"))
    return facts.filter((F.col("lang") == "sh") & (F.startswith(t, F.lit("source ")) | F.startswith(t, F.lit(". ")))).select("path", "line_no", F.lit("include").alias("kind"), clip(squeeze(t), 500).alias("target"))


def detect_changes(stored: DataFrame, seen: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """JOIN-10, JOIN-11, STM-02, STM-05: (path, change): added, changed, unchanged or deleted, from stored and seen (path, sha256).

    Only the hash decides. A path without a stored hash (deleted before) is added. Paths outside the targets aren't
    deleted. One full join on the path does it all.
    """
    old = stored.select("path", F.col("sha256").alias("__old"), F.lit(True).alias("__stored"))
    new = seen.select("path", F.col("sha256").alias("__new"), F.lit(True).alias("__seen"))
    j = old.join(new, "path", "full")
    change = (
        F.when(F.col("__seen").isNull() & F.col("__old").isNull(), None).when(F.col("__seen").isNull(), "deleted").when(F.col("__old").isNull(), "added")
        .when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    )
    out = j.select("path", change.alias("change")).filter("change is not null")
    return out if not targets else out.filter("change <> 'deleted'").unionByName(in_targets(out.filter("change = 'deleted'"), targets))


def merge_files(stored: DataFrame, seen: DataFrame, scan: Column, whole: bool = True) -> DataFrame:
    """STM-02, STM-03, STM-05: the file table after a scan: (path, sha256, status, first_scan, changed_scan, seen_scan).

    An unchanged hash only moves seen_scan; a gone path keeps a row without hash, status deleted. Where seen is only part
    of a scan (whole=False), paths outside it stay as they are.
    """
    old = stored.select("path", *[F.col(c).alias(f"__{c}") for c in ("sha256", "status", "first_scan", "changed_scan", "seen_scan")], F.lit(True).alias("__stored"))
    new = seen.select("path", F.col("sha256").alias("__new"), F.col("status").alias("__new_status"), F.lit(True).alias("__seen"))
    j = old.join(new, "path", "full")
    here, same = F.col("__seen").isNotNull(), F.coalesce(F.col("__sha256") == F.col("__new"), F.lit(False))
    gone = (lambda c, x: F.lit(x)) if whole else (lambda c, x: F.col(c))
    return j.select(
        "path", F.when(here, F.col("__new")).otherwise(gone("__sha256", None)).alias("sha256"), F.when(here, F.col("__new_status")).otherwise(gone("__status", "deleted")).alias("status"), F.coalesce("__first_scan", scan).alias("first_scan"),
        F.when(here & same, F.col("__changed_scan")).when(~here & (F.lit(not whole) | (F.col("__status") == "deleted")), F.col("__changed_scan")).otherwise(scan).alias("changed_scan"), F.when(here, scan).otherwise(F.col("__seen_scan")).alias("seen_scan"),
    )


def end_scan(stored: DataFrame, scan: Column) -> DataFrame:
    """STM-05: the file table once a scan has ended: what it has not seen becomes deleted, without hash."""
    gone = (F.col("seen_scan") < scan) & (F.col("status") != "deleted")
    return stored.withColumns({"sha256": F.when(~gone, F.col("sha256")), "status": F.when(gone, "deleted").otherwise(F.col("status")), "changed_scan": F.when(gone, scan).otherwise(F.col("changed_scan"))})


def search_symbols(symbols_: DataFrame, files: DataFrame, part: str) -> DataFrame:
    """PRED-15, JOIN-01, WIN-17: symbols whose name is like %part%, any case, with their file's path; % and _ in part stay wildcards."""
    hit = symbols_.filter(F.col("name").ilike(f"%{part}%"))
    return hit.join(files.select("file_id", "path"), "file_id").orderBy("path", "line", "kind", "name")


def query_files(files: DataFrame, lang: str | None = None, status: str | None = None) -> DataFrame:
    """PRED-14, PRED-16."""
    for name, value in (("lang", lang), ("status", status)):
        if value is not None:
            files = files.filter(F.col(name) == value)
    return files.orderBy("path")


def upsert_entities(seen: DataFrame, key: str) -> DataFrame:
    """STM-04: a row a key: first_seen kept, last_seen moved, the last non-null of each other column (of several at one time the greatest)."""
    rest = [c for c in seen.columns if c not in (key, "seen_at")]
    return seen.groupBy(key).agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), *[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("seen_at"), F.col(c).alias("v"))))["v"].alias(c) for c in rest])


def scan_totals(files: DataFrame) -> DataFrame:
    """AGG-14, STM-19: a row a scan."""
    return files.groupBy("scan_id").agg(F.count("*").alias("seen"), F.count_if(F.col("change").isin("added", "changed")).alias("changed"), F.count_if(F.col("status") == "parsed").alias("parsed"), F.when(F.count_if(F.col("status") == "parse_error") > 0, "partial").otherwise("ready").alias("scan_state"))


def include_closure(edges: DataFrame, seeds: DataFrame, depth: int = 8, most: int = 32) -> DataFrame:
    """WIN-20: (root, path, depth): what each seed reaches within depth steps, the `most` nearest by depth, then path.

    Each round joins the frontier with the edges, drops what was met and is checkpointed; a round without news is the last.
    """
    met = seeds.select(F.col("path").alias("root"), "path", F.lit(0).alias("depth"))
    frontier = met
    for k in range(1, depth + 1):
        step = frontier.select("root", F.col("path").alias("source")).join(edges, "source").select("root", F.col("target").alias("path")).distinct()
        frontier = cut(step.join(met.select("root", "path"), ["root", "path"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        met = met.unionByName(frontier)
    rank = F.row_number().over(Window.partitionBy("root").orderBy("depth", "path"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
