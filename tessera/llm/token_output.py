"""Token-id files in patched frame-of-reference blocks.

A segment (the bytes of one row's `data`) holds whole documents of one shard, in order:

    "PFR1", then little-endian unsigned 32-bit: number of ids, number of blocks
    for each block: its minimum (u32); where its packed words start (u32, the block index); its exceptions' end (u32); its width (u8)
    packed area: for each block BLOCK deltas of `width` bits each, lane by lane, in 64-bit words
    exceptions: values (u32), then places within the block (u8)

A block's deltas to its minimum are packed at the width that PERCENTILE of them fit; those that don't are exceptions.
The last block is filled up with its minimum. Any block can be read alone through the index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokens import encoder

BLOCK, LANE, PERCENTILE = 256, 64, 90
MAGIC = b"PFR1"
SCHEMA = "shard long, seq long, first long, n_ids long, doc_ids array<bigint>, doc_lens array<bigint>, data binary"


_BITS = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _widths(deltas: np.ndarray) -> np.ndarray:
    """Bits of each delta (uint32)."""
    if not deltas.size or deltas.max() < 1 << 16:
        return _BITS[deltas]
    high = deltas >> np.uint32(16)
    return np.where(high > 0, 16 + _BITS[high], _BITS[deltas & np.uint32(0xFFFF)]).astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Ids (uint32) as one segment."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n % BLOCK:
        full[n:] = ids[(blocks - 1) * BLOCK :].min()
    full = full.reshape(blocks, BLOCK)
    least = full.min(1) if blocks else np.zeros(0, np.uint32)
    deltas = full - least[:, None]
    bits = _widths(deltas)
    kth = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.partition(bits, kth, axis=1)[:, kth] if blocks else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    row, place = np.nonzero(over)
    values = deltas[row, place]
    deltas[over] = 0
    words = width.astype(np.int64) * (BLOCK // LANE)
    starts = np.cumsum(words) - words
    area = np.zeros(int(words.sum()), np.uint64)
    for w in np.unique(width):
        if w:
            g = np.flatnonzero(width == w)
            cols = np.ascontiguousarray(deltas[g].reshape(-1, LANE).T.astype(np.uint64))
            out = np.zeros((int(w), cols.shape[1]), np.uint64)
            for j in range(LANE):
                at, shift = divmod(j * int(w), 64)
                out[at] |= cols[j] << np.uint64(shift)
                if shift + w > 64:
                    out[at + 1] |= cols[j] >> np.uint64(64 - shift)
            area[starts[g][:, None] + np.arange(int(w) * (BLOCK // LANE))] = out.T.reshape(len(g), -1)
    ends = np.cumsum(over.sum(1)) if blocks else np.zeros(0)
    head = MAGIC + np.array([n, blocks], "<u4").tobytes()
    return b"".join([head, least.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), ends.astype("<u4").tobytes(), width.tobytes(), area.astype("<u8").tobytes(), values.astype("<u4").tobytes(), place.astype(np.uint8).tobytes()])


def unpack(data: bytes) -> np.ndarray:
    """The ids (uint32) of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks = map(int, np.frombuffer(data, "<u4", 2, 4))
    at = 12
    least, starts, ends = (np.frombuffer(data, "<u4", blocks, at + 4 * blocks * k) for k in range(3))
    width = np.frombuffer(data, np.uint8, blocks, at := at + 12 * blocks)
    words = int(width.astype(np.int64).sum()) * (BLOCK // LANE)
    area = np.frombuffer(data, "<u8", words, at := at + blocks)
    m = int(ends[-1]) if blocks else 0
    values = np.frombuffer(data, "<u4", m, at := at + 8 * words)
    place = np.frombuffer(data, np.uint8, m, at + 4 * m)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            g = np.flatnonzero(width == w)
            lanes = np.ascontiguousarray(area[starts[g].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // LANE))].reshape(-1, int(w)).T)
            cols, mask = np.empty((LANE, lanes.shape[1]), np.uint32), np.uint64((1 << int(w)) - 1)
            for j in range(LANE):
                k, shift = divmod(j * int(w), 64)
                v = lanes[k] >> np.uint64(shift)
                if shift + w > 64:
                    v = v | (lanes[k + 1] << np.uint64(64 - shift))
                cols[j] = v & mask
            out[g] = cols.T.reshape(len(g), BLOCK)
    out[np.repeat(np.arange(blocks), np.diff(ends.astype(np.int64), prepend=0)), place] = values
    out += least[:, None]
    return out.reshape(-1)[:n]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, segment_ids: int = 1 << 18) -> DataFrame:
    """Encode docs' texts in ascending doc_id order, each closed by end_id, into segment files in the shared folder.

    Returns the written table (SCHEMA): a shard for each range of doc_id, its segments in order. Null doc_ids come
    first, ties follow the text's hash; a null or empty text gives end_id alone; an empty table gives no segment.
    The texts are range-partitioned before they are encoded, as sampling the ranges would otherwise encode them twice,
    and streamed through, so that a task holds one segment (whole documents of about segment_ids ids) at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        seq = first = 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, first
            ids = np.concatenate([h[2] for h in held])
            docs_of, lens = [x for h in held for x in h[0]], np.concatenate([h[1] for h in held])
            out = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "seq": pa.array([seq], pa.int64()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": pa.array([docs_of], pa.list_(pa.int64())), "doc_lens": pa.array([lens.tolist()], pa.list_(pa.int64())), "data": pa.array([pack(ids)], pa.binary())})
            seq, first = seq + 1, first + len(ids)
            held.clear()
            return out

        for b in slices(batches, "text", 1 << 20):
            ids, lens = enc.encode(b.column("text"), end_id)
            held.append((b.column("doc_id").to_pylist(), lens, ids))
            if sum(len(h[2]) for h in held) >= segment_ids:
                yield flush()
        if held:
            yield flush()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return materialize(ordered.select("doc_id", "text").mapInArrow(run, SCHEMA), "tokens")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from written segments.

    start counts the ids of all documents before; shard totals (one row a shard) are the only thing summed in order.
    """
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard")) - F.col("n")
    based = files.join(totals.select("shard", before.alias("base")), "shard").select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "doc_lens", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, doc_ids, lens, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                raw, ends = memoryview(unpack(data).astype("<u4").tobytes()), np.cumsum(lens)
                begins = ends - lens
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(begins + start, pa.int64()), "n_tokens": pa.array(lens, pa.int64()), "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())})

    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
