"""Reads over the index tables: facts of a scan's files, decisions with their gates. One join each, however many files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_facts(files: DataFrame, facts: DataFrame, columns: list[str], scan: int | None = None) -> DataFrame:
    """JOIN-02..05: facts (file_id, ...) of the given files, with their path, in order; with a scan only facts of that scan.

    Symbols, diagnostics and metrics are those of all selected files; edges only those of the exported scan, so that
    edges of unchanged files are left out of incremental exports.
    """
    rows = facts if scan is None else facts.filter(F.col("scan_id") == scan)
    return rows.join(files.select("file_id", "path"), "file_id").orderBy("path", *columns)


def scan_repository(repos: DataFrame, scans: DataFrame, scan: int) -> DataFrame:
    """JOIN-06."""
    return scans.filter(F.col("scan_id") == scan).select("repo_id").join(repos, "repo_id")


def with_gates(decisions: DataFrame, gates: DataFrame) -> DataFrame:
    """JOIN-07: decisions with their gates as an array in order of gate_id; none: an empty one."""
    nested = gates.groupBy("decision_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gate_id", "name", "status"))), lambda g: F.struct(g["name"].alias("name"), g["status"].alias("status"))).alias("gates"))
    out = decisions.join(nested, "decision_id", "left")
    return out.withColumn("gates", F.coalesce("gates", F.array().cast(out.schema["gates"].dataType)))


def find_decisions(decisions: DataFrame, repository=None, target=None, disposition=None) -> DataFrame:
    """PRED-13: those that meet every given condition, the newest run first."""
    for name, value in (("repository", repository), ("target", target), ("disposition", disposition)):
        if value is not None:
            decisions = decisions.filter(F.col(name) == value)
    return decisions.orderBy(F.desc("run_id"), "decision_id")
