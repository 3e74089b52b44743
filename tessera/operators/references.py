"""Manifest references: edges, resolutions, findings, hand-offs, queue items. All built-in functions, rows exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CODE_NEWLINE, let, lines, queue_item_id, strip, strip_git

#: prefix, method (fixed values).
REMOTES = (("git+ssh://git@github.com/", "git_ssh_remote_parse"), ("git@github.com:", "ssh_remote_parse"), ("https://github.com/", "https_remote_parse"))


def _owner_repo(s: Column) -> Column:
    """owner/repo of a text, or null: two non-empty parts and no more; .git and outer slashes go."""
    t = strip_git(F.regexp_replace(F.trim(s), "^/+|/+$", ""))
    return F.when(t.rlike("^\\s*[^/\\s][^/]*/\\s*[^/\\s][^/]*$"), F.concat_ws("/", F.trim(F.split_part(t, F.lit("/"), F.lit(1))), F.trim(F.split_part(t, F.lit("/"), F.lit(2)))))


def normalize_reference(raw: Column) -> Column:
    """STR-20, STR-21: struct<posture, method, identity>: the first prefix whose rest parses, relative paths, owner/repo, else unresolved."""

    def of(t: Column) -> Column:
        branch = lambda cond, posture, method, identity: F.when(cond, F.struct(F.lit(posture).alias("posture"), F.lit(method).alias("method"), identity.cast("string").alias("identity")))
        remote = []
        for prefix, method in REMOTES:
            rest = _owner_repo(F.substring(t, len(prefix) + 1, 1 << 20))
            remote.append(branch(F.startswith(t, F.lit(prefix)) & rest.isNotNull(), "resolved", method, rest))
        relative = branch(t.rlike("^\\.\\.?/"), "ambiguous", "relative_path_inference", F.lit(None))
        direct = branch(_owner_repo(t).isNotNull(), "resolved", "owner_repo_direct", _owner_repo(t))
        return F.coalesce(*remote, relative, direct, branch(F.lit(True), "unresolved", "none", F.lit(None)))

    return let(F.trim(raw), of)


def is_repo_reference(value: Column) -> Column:
    """PRED-18."""
    v = F.trim(value)
    remote = F.contains(v, F.lit("github.com/")) | F.startswith(v, F.lit("git@github.com:")) | F.startswith(v, F.lit("git+ssh://"))
    return remote | (F.contains(v, F.lit("/")) & ~v.rlike("^[~^]") & ~v.rlike("^[0-9.]*$"))


def _numbered(edges: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    by = Window.partitionBy("repo", "path").orderBy(*order)
    return edges.withColumn("edge_id", F.concat(F.lit(f"{prefix}-edge-"), F.row_number().over(by).cast("string")))


def module_edges(files: DataFrame) -> DataFrame:
    """UDF-08: `url = ` lines of a module list. files: repo, path, text."""
    rows = files.select("repo", "path", F.posexplode(lines(F.col("text"), CODE_NEWLINE)).alias("at", "line"))
    raw = F.trim(F.regexp_extract(strip(F.col("line")), "^url = (.+)$", 1))
    return _numbered(rows.withColumn("raw", raw).filter("raw <> ''"), "gitmodules", ["at"]).select("repo", "path", "edge_id", F.lit("git_submodule").alias("relation"), F.lit("gitmodules_parse").alias("method"), "raw")


def package_references(files: DataFrame) -> DataFrame:
    """UDF-09, SRC-13: the three dependency sections of a package.json, in order of section, then name; reason is null where it's an edge.

    What isn't JSON has no row; values that aren't text are skipped as such.
    """
    sections = ("dependencies", "devDependencies", "peerDependencies")
    parsed = files.select("repo", "path", *[F.from_json("text", f"{s} map<string,string>", {"mode": "PERMISSIVE"})[s].alias(s) for s in sections], "text")
    all_ = F.flatten(F.array(*[F.coalesce(F.transform(F.array_sort(F.map_entries(s)), lambda e, k=k: F.struct(F.lit(k).alias("section"), e["key"].alias("name"), e["value"].alias("raw"))), F.array().cast("array<struct<section:int,name:string,raw:string>>")) for k, s in enumerate(sections)]))
    rows = parsed.select("repo", "path", F.posexplode(all_).alias("at", "r"), *[F.lit(s).alias(f"__{k}") for k, s in enumerate(sections)], "text").select("repo", "path", "at", "r.*")
    reason = F.when(F.col("raw").isNull(), "non_string_dependency_value").when(~is_repo_reference(F.col("raw")), "non_repo_style_dependency_reference")
    return rows.withColumn("reason", reason)


def package_edges(files: DataFrame) -> DataFrame:
    return _numbered(package_references(files).filter("reason is null"), "package", ["at"]).select("repo", "path", "edge_id", F.lit("dependency_repo_reference").alias("relation"), F.lit("package_manifest_parse").alias("method"), "raw")


def requirement_edges(files: DataFrame) -> DataFrame:
    """UDF-12: requirement lines that name a repository; comments, blank lines, options and includes are skipped."""
    rows = files.select("repo", "path", F.posexplode(lines(F.col("text"), CODE_NEWLINE)).alias("at", "line")).withColumn("raw", strip(F.col("line")))
    named = F.contains("raw", F.lit(" @ git+")) | F.startswith("raw", F.lit("git+https://")) | F.startswith("raw", F.lit("git+ssh://")) | F.contains("raw", F.lit("github.com/"))
    kept = rows.filter(~F.col("raw").rlike("^(#|-|$)") & named)
    return _numbered(kept, "requirements", ["at"]).select("repo", "path", "edge_id", F.lit("dependency_repo_reference").alias("relation"), F.lit("requirements_parse").alias("method"), "raw")


def workflow_edges(files: DataFrame) -> DataFrame:
    """UDF-13: what a workflow's `uses:` lines name."""
    rows = files.select("repo", "path", F.posexplode(lines(F.col("text"), CODE_NEWLINE)).alias("at", "line"))
    raw = F.regexp_replace(F.trim(F.regexp_extract(strip(F.col("line")), "^(?:- )?uses:\\s*(.+)$", 1)), "^[\"']|[\"']$", "")
    return _numbered(rows.withColumn("raw", raw).filter("raw <> ''"), "workflow", ["at"]).select("repo", "path", "edge_id", F.lit("workflow_reference").alias("relation"), F.lit("ci_workflow_parse").alias("method"), "raw")


def all_edges(*edges: DataFrame) -> DataFrame:
    """WIN-21, WIN-24, UDF-14."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def resolve(edges: DataFrame) -> DataFrame:
    """UDF-15: edges with posture, method of resolution and identity."""
    return edges.withColumn("__r", normalize_reference(F.col("raw"))).withColumns({"posture": F.col("__r.posture"), "resolution": F.col("__r.method"), "identity": F.col("__r.identity")}).drop("__r")


def findings(resolved: DataFrame) -> DataFrame:
    """UDF-16, UDF-17: a finding for each ambiguous edge and no other, with its issue key repo::reason::edge."""
    reason = F.lit("ambiguous_target")
    return resolved.filter("posture = 'ambiguous'").withColumns({"reason": reason, "issue_key": F.concat_ws("::", "repo", reason, "edge_id")})


def adapter_counts(edges: DataFrame) -> DataFrame:
    """AGG-15: edges by adapter and by source artifact, in one pass."""
    return edges.groupingSets([["method"], ["path"]], "method", "path").agg(F.count("*").alias("edges"))


def queue_items(found: DataFrame, intake: str = "candidate_issues", lane: str = "references") -> DataFrame:
    """UDF-18, STR-16, AGG-21, STM-06: one queue item a repository, its issues' keys in order; no issue of this path blocks."""
    per = found.groupBy("repo").agg(F.sort_array(F.collect_set("issue_key")).alias("issue_keys"))
    return per.select(queue_item_id(F.lit(intake), F.lit(lane), F.col("repo"), F.concat(F.lit("handoff-"), "repo"), F.col("issue_keys")).alias("item_id"), "repo", "issue_keys", F.size("issue_keys").alias("issues"), F.lit(0).alias("blocking"))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JOIN-16: keys without a counterpart; empty when references hold."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def correspondence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JOIN-17, WIN-22: how many distinct keys are in both, and in one alone."""
    l, r = left.select(key).distinct().withColumn("__l", F.lit(True)), right.select(key).distinct().withColumn("__r", F.lit(True))
    j = l.join(r, key, "full")
    return j.agg(F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("both"), F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"))


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """WIN-10: the row of the greatest time (a timestamp or number) a key; ties keep the first by `tie`.

    One aggregate with partial results, so a hot key is combined before the only exchange.
    """
    rest = [c for c in rows.columns if c != key]
    kind = rows.schema[at].dataType.typeName()
    when = F.unix_micros(F.col(at).cast("timestamp")) if kind.startswith("timestamp") else F.col(at)
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(-when, F.col(tie))).alias("r"))
    return best.select(key, *[F.col("r")[c].alias(c) for c in rest])
