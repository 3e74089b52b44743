"""Project directories: an index file against its data folders. They are observed, never extracted."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])


def binder_items(indexes: DataFrame) -> DataFrame:
    """AGG-26: indexes (project, content) as one row an item: uuid, type, depth (1 at the top); a broken index is a row without uuid, type 'broken'.

    The tree is walked with a stack, so depth has no limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for project, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    binder = ElementTree.fromstring(content or b"").find("Binder")
                except ElementTree.ParseError:
                    binder = None
                if binder is None:
                    rows.append((project, None, "broken", 0))
                    continue
                todo = [(e, 1) for e in binder if e.tag == "BinderItem"]
                while todo:
                    e, depth = todo.pop()
                    rows.append((project, e.get("UUID"), e.get("Type"), depth))
                    todo += [(x, depth + 1) for c in e if c.tag == "Children" for x in c if x.tag == "BinderItem"]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], ["project", "uuid", "type", "depth"])

    return indexes.select("project", "content").mapInArrow(run, "project string, uuid string, type string, depth int")


def observe_projects(files: DataFrame, suffix: str = "scriv") -> DataFrame:
    """SRC-08, JOIN-17, AGG-26: a row a project: state, reason, mapping and counts, from its files (path, content).

    A project is a folder named *.suffix. It is ready if it has exactly one readable index (*.suffix + x) at its top, a
    data folder, and a content file for each text item that has a folder there. The mapping is a candidate if items
    and folders meet and no folder is without an item, else unresolved.
    """
    inner = f"^(.*?[^/]*\\.{suffix})/(.*)$"
    rows = files.withColumns({"project": F.regexp_extract("path", inner, 1), "rest": F.regexp_extract("path", inner, 2)}).filter("project <> ''")
    index = rows.filter(F.col("rest").rlike(f"^[^/]+\\.{suffix}x$"))
    folders = rows.withColumn("uuid", F.regexp_extract("rest", "^Files/Data/([^/]+)/", 1)).filter("uuid <> ''").groupBy("project", "uuid").agg(F.bool_or(F.col("rest").rlike("^Files/Data/[^/]+/content\\.rtf$")).alias("has_content"))
    items = binder_items(index)
    pairs = items.filter("type <> 'broken'").withColumn("item", F.lit(True)).join(folders.withColumn("folder", F.lit(True)), ["project", "uuid"], "full")
    met = pairs.groupBy("project").agg(
        F.count_if(F.col("item") & F.col("folder")).alias("both"), F.count_if(F.col("item") & F.col("folder").isNull() & F.col("uuid").isNotNull()).alias("only_items"), F.count_if(F.col("item").isNull()).alias("only_folders"),
        F.count_if(F.col("item") & (F.col("type") == "Text") & (F.col("has_content") == F.lit(False))).alias("without_content"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.count_if("item").alias("items"), F.count_if("folder").alias("folders"),
    )
    broken = items.groupBy("project").agg(F.bool_or(F.coalesce(F.col("type") == "broken", F.lit(False))).alias("broken"))
    base = rows.groupBy("project").agg(F.count_if(F.col("rest").rlike(f"^[^/]+\\.{suffix}x$")).alias("indexes"))
    j = base.join(broken, "project", "left").join(met, "project", "left").na.fill(0).na.fill(False)
    reason = F.when((F.col("indexes") != 1) | F.col("broken") | (F.col("folders") == 0) | (F.col("without_content") > 0), "dependency_unavailable")
    mapping = F.when(reason.isNotNull(), "mapping_unavailable").when((F.col("both") > 0) & (F.col("only_folders") == 0), "candidate_mapping_observed").otherwise("mapping_unresolved")
    return j.select("project", F.when(reason.isNull(), "ready").otherwise("unavailable").alias("state"), reason.alias("reason"), mapping.alias("mapping"), "items", "depth", "both", "only_items", "only_folders", "without_content")
