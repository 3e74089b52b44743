"""What the operators of this subpackage share: the shared folder, written intermediate tables, worker state."""

from __future__ import annotations

import re
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word, for Java's, DuckDB's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

# Executors need not have this repository on their path: functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own if the session is local, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    The table goes when the driver ends, as the result may be read until then; discard() deletes it sooner.
    """
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    fs, hpath = _folder(df.sparkSession, path)
    fs.deleteOnExit(hpath)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df; nothing may read it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        fs, hpath = _folder(df.sparkSession, path)
        fs.delete(hpath, True)


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with `nth` (long, from 0, in this order) and, for each name, the sum of its column over all rows before.

    Rows are dealt out by range, so no task holds all of them; only a row a partition is put in one place. The order
    must be total. df must not have the columns nth, pid or those of sums.
    """
    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()), "running")
    totals = parts.groupBy("pid").agg(F.count("*").alias("nth_all"), *[F.sum(c).alias(f"{n}_all") for n, c in sums.items()])
    upto = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    based = totals.select("pid", *[F.coalesce(F.sum(f"{n}_all").over(upto), F.lit(0)).alias(f"{n}_base") for n in ("nth", *sums)])
    here = Window.partitionBy("pid").orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(based, "pid")
    nth = (F.row_number().over(here) - 1 + F.col("nth_base")).alias("nth")
    return joined.select(*df.columns, nth, *[(F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"{n}_base")).alias(n) for n, c in sums.items()])


def worker_state(key: str, make: Callable):
    """One object per worker process and key, kept across tasks."""
    held = sys.modules.get("_tessera_state")
    if held is None:
        held = sys.modules["_tessera_state"] = types.ModuleType("_tessera_state")
        held.kept = {}
    if key not in held.kept:
        held.kept[key] = make()
    return held.kept[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded number of text bytes (one row at least). What Arrow holds free goes back at the end."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n, at = len(col), 0
        if not n:
            continue
        width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
        offs = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + n + 1]
        while at < n:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, min(end, n) - at)
            at = min(end, n)
    pa.default_memory_pool().release_unused()


#: Bytes of a long text that are worked on at once.
PIECE = 4 << 20
_GAP = re.compile(rb"[\x20\t-\r]")


def cut_at_spaces(raw: bytes, most: int = PIECE) -> Iterator[bytes]:
    """raw in pieces of at most `most` bytes that end behind white space; a longer word stays whole."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + most)
        if end < len(raw):
            cut = max(raw.rfind(bytes([c]), at, end) for c in SPACES)
            if cut < at:
                gap = _GAP.search(raw, end)
                cut = gap.start() if gap else len(raw) - 1
            end = cut + 1
        yield raw[at:end]
        at = end


def keys128(*columns: str) -> tuple[Column, Column]:
    """Two never-null longs, a 128-bit hash of columns: what rows share that are equal in them, nulls included."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of an id as decimal text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, **columns: str) -> StructType:
    """df's schema with further columns (df.schema itself must not be changed)."""
    out = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out
