"""Best-fit packing of token pieces into sequences, after Martello and Toth's dominance reduction.

Lengths are whole numbers of 1 to `capacity`, so the instance is a histogram of bounded size however many pieces there
are: reduction and best fit run on it with multiplicities. Their answer, a list of patterns with counts, is dealt out
to the pieces by their rank within a length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, materialize, slices, spare
from .tokens import encoder

#: Pieces of one length that one task ranks, about: a length with more is ranked in so many parts. Where that makes more than PARTS
#: parts of all pieces, parts are larger.
RANKED, PARTS = 5_000, 200_000


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, k2, piece, start, length, ids_crc32): encoded documents, those above capacity cut into pieces of it.

    Null text counts as empty and gives the end id alone. k2 is the text's hash, which puts documents of one id in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in slices(batches, "text", 1 << 20):
            ids, lens = enc.encode(b.column("text"), end_id)
            raw = memoryview(ids.astype("<u4", copy=False).tobytes())
            n = -(-lens // capacity)
            doc = np.repeat(np.arange(len(lens)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, lens[doc] - start)
            begin = np.repeat(np.cumsum(lens) - lens, n) + start
            crcs = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(begin.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), b.column("k2").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "k2", "piece", "start", "length", "ids_crc32"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k2"), "text")
    return keyed.mapInArrow(run, "doc_id long, k2 long, piece int, start long, length long, ids_crc32 long")


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how often each is used, for counts of pieces by length.

    Reduction, from the longest length j down, while one of these holds: j and a length k fill a sequence exactly, or
    only one piece fits beside j (the longest that fits dominates), or only two do and the longest a with the longest b
    beside it is at least, one by one, any pair that fits. Such sets are fixed for good. The rest is packed best fit,
    longest first.
    """
    left = {k: v for k, v in counts.items() if v}
    done: dict[tuple[int, ...], int] = defaultdict(int)

    def take(*lengths: int) -> None:
        need: dict[int, int] = defaultdict(int)
        for k in lengths:
            need[k] += 1
        times = min(left[k] // v for k, v in need.items())
        for k, v in need.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
        done[lengths] += times

    def longest(most: int, used: dict[int, int]) -> int:
        """The longest length up to most of which a piece is left besides those used; 0: none."""
        return next((k for k in range(most, 0, -1) if left.get(k, 0) > used.get(k, 0)), 0)

    def smallest(n: int, used: dict[int, int]) -> list[int]:
        out: list[int] = []
        for k in sorted(left):
            out += [k] * min(n - len(out), left[k] - used.get(k, 0))
            if len(out) >= n:
                break
        return out

    for j in range(capacity, 0, -1):
        while left.get(j):
            room, used = capacity - j, {j: 1}
            a = longest(room, used)
            if not a:
                take(j)
                continue
            least = smallest(3, used)
            if a == room or len(least) < 2 or sum(least[:2]) > room:
                take(j, a)
                continue
            if len(least) < 3 or sum(least) > room:
                used[a] = used.get(a, 0) + 1
                b = longest(min(a, room - a), used)
                used[a] -= 1
                half = longest(room // 2, used)  # no pair that fits has a second member above it
                if b and b >= half:
                    take(j, a, b)
                    continue
            break

    open_: dict[int, list[list]] = defaultdict(list)  # by room left: [pattern, times]
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            room = next((r for r in range(k, capacity) if open_.get(r)), capacity)
            pattern, times = open_[room].pop() if open_.get(room) else ((), n)
            fit = room // k
            full = min(times, n // fit)
            if full:
                open_[room - fit * k].append([pattern + (k,) * fit, full])
            n -= full * fit
            rest = times - full
            if rest and n and pattern == ():
                open_[room - n * k].append([(k,) * n, 1])
                n, rest = 0, 0
            elif rest and n:
                open_[room - n * k].append([pattern + (k,) * n, 1])
                n, rest = 0, rest - 1
            if rest and pattern:
                open_[room].append([pattern, rest])
    for groups in open_.values():
        for pattern, times in groups:
            if pattern:
                done[tuple(pattern)] += times
    return list(done.items())


def pack_pieces(pieces: DataFrame, capacity: int, ranked: int = RANKED) -> DataFrame:
    """pieces with sequence_id and offset (long): no sequence holds more than capacity, offsets have no gaps from 0.

    pieces: materialized rows of cut_pieces(). A piece of the whole capacity is a sequence by itself, numbered below zero
    by its row. Others are ranked within their length, in parts of about `ranked` pieces, so that one common length is
    shared out among tasks. The driver gets a number for each length and part: capacity + PARTS of them at most.
    """
    names = pieces.columns
    salt, base, rank, all_ = spare(pieces, "salt", "base", "rank", "all")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    whole = counts.pop(capacity, 0)
    ranked = max(ranked, sum(counts.values()) // PARTS)
    parts = {k: -(-v // ranked) for k, v in counts.items()}

    spans: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for pattern, times in pack_histogram(counts, capacity):
        at = 0
        for k in pattern:
            spans[k].append((times, first, at))
            at += k
        first += times
    low, seq, off = {}, {}, {}
    for k, v in spans.items():
        times, seq[k], off[k] = (np.array(x, np.int64) for x in zip(*v, strict=True))
        low[k] = np.cumsum(times) - times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, start, place = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", base, rank))
            place = place - 1 + start
            s, o = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                mine = np.flatnonzero(length == k)
                which = np.searchsorted(low[k], place[mine], "right") - 1
                s[mine], o[mine] = seq[k][which] + place[mine] - low[k][which], off[k][which]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(s), pa.array(o)], [*names, "sequence_id", "offset"])

    spark = pieces.sparkSession
    shorter = pieces.filter(F.col("length") < capacity) if whole else pieces
    sizes = spark.createDataFrame([(k, v) for k, v in parts.items()], f"length long, `{all_}` long")
    salted = shorter.join(F.broadcast(sizes), "length").withColumn(salt, F.pmod(F.xxhash64("doc_id", "k2", "piece"), F.col(all_)))  # at most `capacity` rows
    filled = sorted((int(r[0]), int(r[1]), int(r[2])) for r in salted.groupBy("length", salt).count().collect()) if any(v > 1 for v in parts.values()) else [(k, 0, v) for k, v in counts.items()]
    bases, total = [], defaultdict(int)
    for k, part, n in filled:
        bases.append((k, part, total[k]))
        total[k] += n
    based = salted.join(F.broadcast(spark.createDataFrame(bases, f"length long, `{salt}` long, `{base}` long")), ["length", salt])  # at most capacity + PARTS rows
    based = based.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "k2", "piece")).cast("long"))
    out = based.select(*names, base, rank).mapInArrow(run, extended(pieces, sequence_id="long", offset="long"))
    if whole:
        alone = pieces.filter(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        out = out.union(alone)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Only documents above capacity are cut. Null text counts as empty; repeated rows and ties of doc_id are packed each for
    itself. A long text is encoded whole, so a task holds its ids beside it. Other columns of docs, whatever their names,
    play no part; an empty table gives no row.
    """
    return pack_pieces(materialize(cut_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity).drop("k2")
