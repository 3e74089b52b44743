"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated random hyperplane bits and compares every
vector with the next WIDTH ones, in double precision. Of the verified pairs a pass hands on those that unite groups;
the union over all passes gives the components. As linked vectors share a component, each vector's links are then
counted within its component, by tiles of bounded size, and never written out as pairs.

Recall rests on the passes alone: a pair is found if some pass brings it, or a chain of links between its two, within a
window. Passes grow with the largest label, so that a lone pair at the threshold is found with probability 0.98 or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import keys128, materialize
from .components import components, forest

THRESHOLD, PASSES, WIDTH, BITS = 0.93, 16, 64, 24
#: Vectors of one block of a large component; blocks are compared two by two.
TILE = 2048


def passes_for(largest: int, threshold: float, width: int) -> int:
    """Passes after which a lone pair at the threshold has met with probability 0.98: in one pass it meets if the two agree in the
    first bits that cut the largest label into windows."""
    cuts = max(0.0, math.log2(max(1, largest) / width))
    agree = (1 - math.acos(threshold) / math.pi) ** cuts
    return max(PASSES, math.ceil(math.log(0.02) / math.log1p(-min(agree, 0.999))))


def _packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): labels as strings, vectors as the bytes of their components; null where one links with nothing."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    embedding = F.col("embedding") if single or (isinstance(kind, ArrayType) and isinstance(kind.elementType, DoubleType)) else F.col("embedding").cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, n = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0  # one zero, not two
            edge = np.concatenate([[0], np.cumsum(n)])
            upto = lambda hit: np.concatenate([[0], np.cumsum(hit)])
            bad, some = upto(~np.isfinite(x)), upto(x != 0)
            ok = (bad[edge[1:]] == bad[edge[:-1]]) & (some[edge[1:]] > some[edge[:-1]]) & b.column(1).is_valid().to_numpy(zero_copy_only=False)
            raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((edge * x.itemsize).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.if_else(pa.array(ok), raw, None).cast(pa.binary())], ["vec_id", "label", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), embedding.alias("e")).mapInArrow(run, "vec_id long, label string, v binary")


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _signed(reps: DataFrame, kind: str, passes: int, bits: int, seed: int) -> DataFrame:
    """reps (id, label, v, rep, n) with their hyperplane bits, one long a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for b in batches:
            raw = b.column(2).to_pylist()
            size = np.array(list(map(len, raw)), np.int64)
            sigs = np.zeros((len(raw), passes), np.int64)
            for s in np.unique(size).tolist():
                if s not in planes:
                    if len(planes) > 3:
                        planes.clear()
                    planes[s] = np.random.default_rng([seed, s]).standard_normal((s // np.dtype(kind).itemsize, passes * bits))
                own = np.flatnonzero(size == s)
                for at in range(0, len(own), 1024):
                    mine = own[at : at + 1024]
                    sigs[mine] = (_unit([raw[k] for k in mine.tolist()], kind) @ planes[s] > 0).reshape(len(mine), passes, bits) @ powers
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * passes, pa.int32()), pa.array(sigs.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["id", "label", "v", "rep", "n", "sigs"])

    return reps.select("id", "label", "v", "rep", "n").mapInArrow(run, "id long, label string, v binary, rep long, n long, sigs array<long>")


def _windows(ordered: DataFrame, kind: str, threshold: float, width: int) -> DataFrame:
    """(a, b): verified pairs within the windows of each ordered stretch (pass, label, id, v) of one pass, label and length, as many as
    unite what they unite. No more than a block and a window of vectors is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = 512
        x, ids, now = np.zeros((0, 0)), np.zeros(0, np.int64), None

        def linked(top: int) -> Iterator[pa.RecordBatch]:
            """Links of the first `top` rows held with those behind them."""
            hit = x[:top] @ x[: top + width].T >= threshold
            a, b = np.nonzero(hit)
            near = (b > a) & (b - a <= width)
            a, b = a[near], b[near]
            keep, _ = forest(a, b, min(len(x), top + width))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[keep]]), pa.array(ids[b[keep]])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)
            p, label = batch.column(0).to_numpy(), np.asarray(batch.column(1).dictionary_encode().indices)
            names = batch.column(1)
            change = (p[1:] != p[:-1]) | (label[1:] != label[:-1]) | (size[1:] != size[:-1])
            cut = np.flatnonzero(np.concatenate([[True], change]))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(p)], strict=True):
                key = (int(p[i]), names[i].as_py(), int(size[i]))
                if now != key:
                    if len(x):
                        yield from linked(len(x))
                    now, x, ids = key, np.zeros((0, key[2] // np.dtype(kind).itemsize)), np.zeros(0, np.int64)
                for k in range(i, j, block):
                    m = min(j, k + block) - k
                    x = np.concatenate([x, _unit(batch.column(3).slice(k, m).to_pylist(), kind)])
                    ids = np.concatenate([ids, batch.column(2).slice(k, m).to_numpy()])
                    if len(x) >= block + width:
                        top = len(x) - width
                        yield from linked(top)
                        x, ids = x[top:], ids[top:]
        if len(x):
            yield from linked(len(x))

    return ordered.mapInArrow(run, "a long, b long")


def _counts(linked: DataFrame, kind: str, threshold: float, tile: int) -> DataFrame:
    """(id, others): how many other vectors, copies counted, each of these (root, id, n, v) links with inside its component.

    A component is dealt into blocks of about `tile` vectors by hash, and each pair of blocks is compared in one place;
    small components share one comparison. Rows out grow with the blocks, not with the pairs.
    """
    sizes = linked.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    dealt = linked.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "v")
    placed = placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> pa.RecordBatch:
            keys, own, ids, n = (np.concatenate([h[k] for h in held]) for k in range(4))
            x = np.concatenate([h[4] for h in held])
            others = np.zeros(len(ids), np.int64)
            group = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(1)]))
            parted = keys[:, 1] != keys[:, 2]
            edges = np.concatenate([np.searchsorted(group, np.unique(group)), [len(group)]])
            at = 0
            while at + 1 < len(edges):  # as many whole tiles as make 512 rows, one at least
                end = max(at + 1, int(np.searchsorted(edges, edges[at] + 512, "right")) - 1)
                a, b = int(edges[at]), int(edges[end])
                two = a + int(np.searchsorted(own[a:b], own[b - 1])) if end == at + 1 and parted[a] else a
                for k in range(two, b, 512):  # rows of one block with all of the other, or all with all
                    top = min(b, k + 512)
                    left = slice(a, two) if two > a else slice(a, b)
                    hit = x[k:top] @ x[left].T >= threshold
                    hit &= group[k:top, None] == group[None, left]
                    if two == a:  # of two blocks only the pairs between them: each block is compared with itself elsewhere
                        hit &= ~parted[k:top, None] | (own[k:top, None] != own[None, left])
                        hit[np.arange(k, top) - k, np.arange(k, top) - a] = False
                    else:
                        others[left] += n[k:top] @ hit
                    others[k:top] += hit @ n[left]
                at = end
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others)], ["id", "others"])

        def rows(b: pa.RecordBatch, i: int, j: int) -> tuple:
            columns = [b.column(k).slice(i, j - i).to_numpy().astype(np.int64) for k in range(6)]
            return np.stack(columns[:3], 1), columns[3], columns[4], columns[5], _unit(b.column(6).slice(i, j - i).to_pylist(), kind)

        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            wide = pc.binary_length(b.column(6)).to_numpy(zero_copy_only=False)
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
                key = (*keys[i].tolist(), int(wide[i]))
                if held and key[:3] != last[:3] and (size >= 4096 or key[3] != last[3]):
                    yield settle()
                    held, size = [], 0
                held.append(rows(b, i, j))
                size, last = size + j - i, key
        if held:
            yield settle()

    return placed.mapInArrow(run, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, width: int = WIDTH, bits: int = BITS, seed: int = 7, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Only vectors of one (non-null) label, of whatever type, and of one length, whatever it is, are compared, by cosine in
    double precision; a vector that is null, empty or zero, or has null or non-finite components, links with nothing.
    Equal vectors of a label are compared once: copies link with each other and share their links, which are counted, not
    written out. component_id is the least vec_id reachable, kept says that it is the row's own. Null vec_ids count as
    links of others but are no component's id; rows that repeat a vec_id are vectors of their own. Other columns play no
    part; an empty table gives no row.
    """
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    largest = vectors.filter(F.col("label").isNotNull()).groupBy("label").count().agg(F.max("count")).first()[0] or 0
    passes = passes or passes_for(largest, threshold, width)
    bits = min(60, max(bits, math.ceil(math.log2(max(1, largest))) + 4))
    rows = _packed(vectors)
    good = rows.filter(F.col("v").isNotNull())
    distinct = good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("id"), "label", "v", "rep", "n"), "vectors")
    reps = materialize(_signed(distinct, kind, passes, bits, seed), "signed")
    each = reps.select("id", "label", "v", F.length("v").alias("size"), F.posexplode("sigs").alias("pass", "sig")).withColumn("tie", F.xxhash64("id", "pass"))
    order = ("pass", "label", "size", "sig", "tie")
    ordered = each.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", "label", "id", "v")
    pairs = materialize(_windows(ordered, kind, threshold, width).distinct(), "pairs")
    roots = materialize(components(pairs).select(F.col("node").alias("id"), "root"), "roots")
    others = _counts(reps.select("id", "n", "v").join(roots, "id"), kind, threshold, tile)
    known = reps.select("id", "label", "v", "rep", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = materialize(known.join(others, "id", "left").select("root", *keys128("label", "v"), "rep", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")).toDF("root", "ka", "kb", "rep", "n_links"), "known")
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "root").select("ka", "kb", "n_links", "component_id")
    keyed = good.select("vec_id", *keys128("label", "v")).toDF("vec_id", "ka", "kb")
    out = keyed.join(known, ["ka", "kb"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.filter(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
