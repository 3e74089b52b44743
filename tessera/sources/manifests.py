"""TOML manifests, and validity of TOML and YAML texts: parsers that Spark lacks, in Arrow stages."""

from __future__ import annotations

import sys
import tomllib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])


def _table(x) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x) -> list:
    return x if isinstance(x, list) else []


def cargo_references(root: dict) -> list[tuple[str, str]]:
    """UDF-10: (method, git address) of the dependency tables, then of the workspace's."""
    tables = [("cargo_manifest_parse", root.get(s)) for s in ("dependencies", "dev-dependencies", "build-dependencies")]
    tables.append(("cargo_workspace_manifest_parse", _table(root.get("workspace")).get("dependencies")))
    return [(method, v["git"]) for method, t in tables for _, v in sorted(_table(t).items()) if isinstance(v, dict) and isinstance(v.get("git"), str)]


def project_references(root: dict) -> list[tuple[str, str]]:
    """UDF-11: (method, text) of the requirement strings and tables that name a repository."""
    project, tool = _table(root.get("project")), _table(root.get("tool"))
    poetry, named = _table(tool.get("poetry")), []
    named += [("pyproject_pep621_parse", x) for x in _list(project.get("dependencies"))]
    named += [("pyproject_optional_dependencies_parse", x) for _, xs in sorted(_table(project.get("optional-dependencies")).items()) for x in _list(xs)]
    groups = [("pyproject_poetry", poetry.get("dependencies"))]
    groups += [("pyproject_poetry_group", _table(g).get("dependencies")) for _, g in sorted(_table(poetry.get("group")).items())]
    out = [(m, x.strip()) for m, x in named if isinstance(x, str) and _is_remote(x.strip())]
    for method, table in groups:
        for _, v in sorted(_table(table).items()):
            if isinstance(v, str) and _is_remote(v.strip()):
                out.append((f"{method}_parse", v.strip()))
            elif isinstance(v, dict) and isinstance(v.get("git"), str):
                out.append((f"{method}_git_parse", v["git"]))
    out += [("pyproject_dependency_groups_parse", x.strip()) for _, xs in sorted(_table(root.get("dependency-groups")).items()) for x in _list(xs) if isinstance(x, str) and _is_remote(x.strip())]
    out += [("pyproject_sources_parse", v["git"]) for _, v in sorted(_table(_table(tool.get("uv")).get("sources")).items()) if isinstance(v, dict) and isinstance(v.get("git"), str)]
    return out


def _is_remote(x: str) -> bool:
    return " @ git+" in x or x.startswith(("git+https://", "git+ssh://")) or "github.com/" in x


KINDS = {"cargo": cargo_references, "pyproject": project_references}


def toml_edges(files: DataFrame) -> DataFrame:
    """UDF-10, UDF-11: files (repo, path, kind, text) as numbered edges; a text that isn't TOML has one row with its error and no edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for repo, path, kind, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    found = KINDS[kind](tomllib.loads(text or ""))
                    rows += [(repo, path, f"{kind}-edge-{k}", "dependency_repo_reference", method, raw, None) for k, (method, raw) in enumerate(found, 1)]
                except (tomllib.TOMLDecodeError, KeyError) as e:
                    rows.append((repo, path, None, None, None, None, "invalid_toml" if isinstance(e, tomllib.TOMLDecodeError) else "unknown_kind"))
            names = ["repo", "path", "edge_id", "relation", "method", "raw", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 7, names)

    return files.select("repo", "path", "kind", "text").mapInArrow(run, "repo string, path string, edge_id string, relation string, method string, raw string, error string")


@F.pandas_udf(BooleanType())
def is_toml(texts: pd.Series) -> pd.Series:
    """STR-35."""

    def one(t):
        try:
            tomllib.loads(t or "")
            return True
        except tomllib.TOMLDecodeError:
            return False

    return texts.map(one)


@F.pandas_udf(BooleanType())
def is_yaml(texts: pd.Series) -> pd.Series:
    """STR-35: null where no YAML parser is installed."""
    try:
        import yaml
    except ImportError:
        return pd.Series([None] * len(texts), dtype="object")

    def one(t):
        try:
            list(yaml.safe_load_all(t or ""))
            return True
        except yaml.YAMLError:
            return False

    return texts.map(one)
