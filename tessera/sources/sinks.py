"""Sinks and stores: JSON lines of records by type, versioned tables, entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def typed_lines(**records: DataFrame) -> DataFrame:
    """SRC-25, SRC-26: one column `value`: {type, record} lines of all given tables."""
    out = None
    for kind, df in records.items():
        line = df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("record"))).alias("value"))
        out = line if out is None else out.unionByName(line)
    return out


def write_lines(path: str, **records: DataFrame) -> None:
    typed_lines(**records).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> int:
    """SRC-24: JSON lines; 0 if every row's state is ready, else 1."""
    df.write.mode("overwrite").json(path)
    return int(not df.filter("state <> 'ready' or state is null").isEmpty())


class Store:
    """SRC-19, SRC-20, SRC-27, SRC-28: tables below a folder, each a series of versions; readers see the last whole one.

    A version is written in full before its marker, so a job that dies leaves the one before. Merges are joins on keys.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def version(self, table: str) -> int:
        fs, path = self._fs()
        at = path(f"{self.path}/{table}")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max([0, *(int(n[1:]) for n in names if n.startswith("v") and fs.exists(path(f"{self.path}/{table}/{n}/_SUCCESS")))])

    def read(self, table: str) -> DataFrame | None:
        v = self.version(table)
        return self.spark.read.parquet(f"{self.path}/{table}/v{v}") if v else None

    def write(self, table: str, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        v = self.version(table) + 1
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{table}/v{v}")
        return self.spark.read.parquet(f"{self.path}/{table}/v{v}")

    def upsert(self, table: str, df: DataFrame, keys: list[str]) -> DataFrame:
        """New rows replace those of their keys."""
        old = self.read(table)
        return self.write(table, df if old is None else old.join(df.select(*keys).distinct(), keys, "left_anti").unionByName(df))
