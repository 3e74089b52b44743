"""Sources: file trees, JSON inputs, observations, queues, repositories."""

from __future__ import annotations

import fnmatch
import os
import shutil
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import is_json
from ..functions.vocabulary import EXCLUDED_DIRS

OBSERVATION = "repository string, revision string, target string, claim_class string, subsystem string, polarity string, strength double, freshness string, health string, observed_at long, observation_id long"


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """SRC-01, SRC-10, AGG-27: path, modified, size, content, sha256 and decodable text of files below a folder, read by executors.

    text is null where the bytes aren't UTF-8 (SRC-02: such a file is denied).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8"))
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("sha256"), text.alias("text"))


def directory_hash(files: DataFrame, root: Column) -> DataFrame:
    """SRC-09: (root, sha256, modified, bytes) of trees: path NUL hash NUL of every member in order of path.

    Members' own hashes are hashed, so a tree's row grows with its number of files and not with their bytes.
    """
    member = F.concat(F.encode("path", "UTF-8"), F.unhex(F.lit("00")), F.encode(F.coalesce("sha256", F.lit("unreadable")), "UTF-8"), F.unhex(F.lit("00")))
    per = files.withColumn("root", root).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("path", F.hex(member).alias("m")))).alias("all"), F.max("modified").alias("modified"), F.sum("size").alias("bytes"))
    return per.select("root", F.sha2(F.unhex(F.array_join(F.transform("all", lambda x: x["m"]), "")), 256).alias("sha256"), "modified", "bytes")


class _Folder(InputPartition):
    def __init__(self, path: str):
        super().__init__(0)
        self.path = path


class TreeSource(DataSource):
    """SRC-10: option("path"): files of a tree that ignore files, hidden names and excluded folders leave; a top folder is a task."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, modified_ns long"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"], self.options.get("hidden", "false") == "true")


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, hidden: bool):
        self.root, self.hidden = root, hidden

    def partitions(self):
        tops = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [_Folder(""), *(_Folder(t) for t in tops)]

    def _kept(self, rel: str, name: str, is_dir: bool, rules: list[tuple[str, str]]) -> bool:
        if (not self.hidden and name.startswith(".")) or (is_dir and name.lower() in EXCLUDED_DIRS):
            return False
        fine = True
        for base, rule in rules:  # the last rule that matches decides
            pattern, keep = (rule[1:], True) if rule.startswith("!") else (rule, False)
            if pattern.endswith("/") and not is_dir:
                continue
            pattern = pattern.rstrip("/")
            inner = os.path.relpath(rel, base) if base else rel
            if fnmatch.fnmatchcase(inner, pattern.lstrip("/")) or ("/" not in pattern and fnmatch.fnmatchcase(name, pattern)):
                fine = keep
        return fine

    def _rules(self, rel: str) -> list[tuple[str, str]]:
        try:
            with open(os.path.join(self.root, rel, ".gitignore"), encoding="utf-8", errors="replace") as f:
                return [(rel, x.rstrip("\n").strip()) for x in f if x.strip() and not x.startswith("#")]
        except OSError:
            return []

    def read(self, partition: _Folder):
        top_rules = self._rules("")
        if partition.path and not self._kept(partition.path, partition.path, True, top_rules):
            return
        todo = [(partition.path, top_rules)]
        while todo:
            rel, rules = todo.pop()
            rules = rules + (self._rules(rel) if rel else [])
            for e in sorted(os.scandir(os.path.join(self.root, rel)), key=lambda e: e.name):
                path = f"{rel}/{e.name}".lstrip("/")
                is_dir = e.is_dir(follow_symlinks=False)
                if not self._kept(path, e.name, is_dir, rules) or e.is_symlink():
                    continue
                if is_dir and partition.path:
                    todo.append((path, rules))
                elif not is_dir:
                    s = e.stat()
                    yield path, s.st_size, s.st_mtime_ns


def walk_tree(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("path", root).option("hidden", str(hidden).lower()).load()


def repository(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: one row: root, ref and commit of the repository above a path; nulls outside of one. Runs on the driver."""
    at = os.path.realpath(path)
    while not os.path.exists(os.path.join(at, ".git")) and os.path.dirname(at) != at:
        at = os.path.dirname(at)
    ask = lambda *a: subprocess.run(["git", "-C", at, *a], capture_output=True, text=True).stdout.strip() or None
    found = os.path.exists(os.path.join(at, ".git")) and shutil.which("git") is not None
    row = (at, ask("rev-parse", "--abbrev-ref", "HEAD"), ask("rev-parse", "HEAD")) if found else (None, None, None)
    return spark.createDataFrame([row], "root string, ref string, commit string")


def staged_paths(spark: SparkSession, root: str) -> DataFrame:
    """SRC-12: paths in the index that differ from the last commit. Runs on the driver."""
    out = subprocess.run(["git", "-C", root, "diff", "--cached", "--name-only", "--diff-filter=ACMR", "-z"], capture_output=True, text=True).stdout
    return spark.createDataFrame([(p,) for p in out.split("\0") if p], "path string")


def host_tools(*names: str) -> dict[str, bool]:
    """PRED-03: which tools the driver's host has."""
    return {n: shutil.which(n) is not None for n in names}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-13, SRC-14: JSON documents or lines, by the first character that isn't blank; broken ones keep their text in _corrupt."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    lines_ = bool(head) and head[0][0].lstrip().startswith("{") and head[0][0].rstrip().endswith("}")
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", str(not lines_).lower()).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: with unknown words set to the defaults: unavailable, unknown, degraded."""
    o = read_json(spark, path, OBSERVATION)
    known = lambda c, values, other: F.when(F.col(c).isin(*values), F.col(c)).otherwise(other)
    return o.withColumns({"polarity": known("polarity", ("supports", "refutes", "unavailable", "not_run"), "unavailable"), "freshness": known("freshness", ("fresh", "historical", "unknown", "stale"), "unknown")})


def read_export(spark: SparkSession, path: str, files_schema: str) -> DataFrame:
    """SRC-15: a crawler's export document, one row a file."""
    doc = spark.read.schema(f"repository string, revision string, files array<struct<{files_schema}>>").option("multiLine", "true").json(path)
    return doc.select("repository", "revision", F.explode("files").alias("f")).select("repository", "revision", "f.*")


def read_queue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-17: one document a file of a queue folder, index.json aside, with its file name (the order of the queue)."""
    docs = spark.read.schema(schema).option("multiLine", "true").json(path)
    return docs.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).filter("file <> 'index.json'")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18, SRC-21, STR-34: whole texts with valid = is JSON; a broken file is a row, not an error."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.withColumn("valid", is_json(F.col("text")))


def required_documents(spark: SparkSession, listing: DataFrame, required: list[str]) -> DataFrame:
    """SRC-22: each required document supports or refutes doc_presence, by the listing (path)."""
    want = spark.createDataFrame([(p,) for p in required], "path string")
    have = listing.select("path").distinct().withColumn("there", F.lit(True))
    return want.join(have, "path", "left").select(F.concat(F.lit("doc:"), "path").alias("target"), F.lit("doc_presence").alias("claim_class"), F.when(F.col("there"), "supports").otherwise("refutes").alias("polarity"))
