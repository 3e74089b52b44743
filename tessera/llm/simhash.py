"""SimHash near-dedup by multi-index hashing over 64-bit fingerprints, and near copies by similarity over wider ones."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_at_spaces, keys128, materialize, slices, spare
from .components import components, forest
from .words import mix

#: Words of a shingle, XXH64's seed, segments of a fingerprint, differing bits of a link.
SHINGLE, SEED, SEGMENTS, REACH = 3, 42, 2, 2
#: Fingerprints of one table entry above which it is looked up by the whole fingerprint's ball instead.
HOT = 1000
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")


def shingle_hashes(text: bytes, words_each: int) -> Iterator[np.ndarray]:
    """XXH64 of each sequence of words_each words of a text (fewer words: of all of them; none: no hash), A-Z in lower case.

    A long text comes in pieces, the last words of each carried into the next, so memory does not grow with it.
    """
    from xxhash import xxh64_intdigest as h

    carried: list[bytes] = []
    found = False
    for piece in cut_at_spaces(text):
        words = carried + [w for w in piece.translate(_UPPER).translate(_SPACE).split(b" ") if w]
        n = len(words) - words_each + 1
        carried = words[max(0, n) :]
        if n < 1:
            continue
        joined, found = b" ".join(words), True
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = [0, *(ends[: n - 1] + 1).tolist()]
        yield np.fromiter((h(joined[a:b], SEED) for a, b in zip(begins, ends[words_each - 1 :].tolist(), strict=True)), np.uint64, n)
    if carried and not found:
        yield np.array([h(b" ".join(carried), SEED)], np.uint64)


def margins(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 bits, from the highest, twice its count less the number of hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return 2 * counts - len(hashes)


def fingerprint(text: bytes) -> int:
    """Unsigned fingerprint of one text: a bit is set if over half the shingles' hashes have it; no words: 0."""
    total = sum((margins(h) for h in shingle_hashes(text, SHINGLE)), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(total > 0).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a long. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t) if t else 0 for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def segment_masks(segments: int) -> list[int]:
    """The bits of each segment of a 64-bit fingerprint; widths differ by one at most."""
    edges = [64 * k // segments for k in range(segments + 1)]
    return [sum(1 << b for b in range(x, y)) for x, y in itertools.pairwise(edges)]


def ball(mask: int, radius: int) -> list[int]:
    """All ways to flip at most `radius` of a segment's bits."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [sum(chosen) for k in range(radius + 1) for chosen in itertools.combinations(bits, k)]


def near_pairs(fps: DataFrame, segments: int = SEGMENTS, reach: int = REACH, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints (column fp) at `reach` or fewer differing bits, enough to connect all such.

    There is a table for each segment, keyed by (segment, its value). Two fingerprints within reach differ in one of the
    segments by at most reach // segments bits. So each fingerprint enumerates the ball of that radius within each of its
    segments, fetches the entries of these values, and each match is verified by its whole distance. An entry with more
    than `hot` fingerprints would pair too many: what reaches such an entry goes by _whole_balls, which links the same.
    """
    masks, radius = segment_masks(segments), reach // segments
    at = lambda s, flip, mask: F.struct(F.lit(s).alias("s"), F.lit(_signed(flip)).alias("flip"), F.lit(_signed(mask)).alias("mask"))
    value = F.col("fp").bitwiseXOR(F.col("x.flip")).bitwiseAND(F.col("x.mask")).alias("value")
    keyed = lambda ways: fps.select("fp", F.explode(F.array(*ways)).alias("x")).select("fp", F.col("x.s").alias("s"), value)
    table = keyed([at(s, 0, m) for s, m in enumerate(masks)])
    lookups = keyed([at(s, flip, m) for s, m in enumerate(masks) for flip in ball(m, radius)])
    crowded = materialize(table.groupBy("s", "value").count().filter(F.col("count") > hot).select("s", "value"), "crowded")
    crowds = not crowded.isEmpty()
    cold = lookups.join(crowded, ["s", "value"], "left_anti") if crowds else lookups
    # the planner takes exploded rows to be as few as fps' and would gather either side in the driver, to broadcast it
    met = cold.withColumnRenamed("fp", "a").hint("merge").join(table.withColumnRenamed("fp", "b").hint("merge"), ["s", "value"])
    pairs = met.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach)).select("a", "b").distinct()
    if crowds:
        pairs = pairs.union(_whole_balls(lookups.join(crowded, ["s", "value"], "left_semi").select("fp").distinct(), reach)).distinct()
    return pairs


def _whole_balls(fps: DataFrame, reach: int) -> DataFrame:
    """(a, b): links that connect all of these fingerprints within reach, however crowded.

    Two such have a common neighbour at most (reach + 1) // 2 bits from each, so the ball of that radius around each
    whole fingerprint is one table. An entry's members are few and lie near each other: they are verified and chained.
    """
    flips = F.array(*[F.lit(_signed(x)) for x in ball((1 << 64) - 1, (reach + 1) // 2)])
    keyed = fps.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "fp")
    chained = keyed.select(F.lag("fp").over(Window.partitionBy("value").orderBy("fp")).alias("a"), F.col("fp").alias("b"))
    return chained.filter(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach)).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lowercase hex digits; component_id: the least doc_id reachable through links, itself included.
    Repeated rows and equal texts share a fingerprint and so a component; a null doc_id is no component's id, so
    component_id is null where a component has no other. Documents without words share fingerprint zero and are linked
    like any other. A text of any length is read whole, in pieces. Other columns of docs, whatever their names, play no
    part. An empty table gives no row.
    """
    marks = materialize(fingerprints(docs), "simhash")
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_pairs(distinct.select("fp"), segments)).select(F.col("node").alias("fp"), "root")
    rooted = materialize(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near copies by similarity: wide fingerprints of five-word shingles

#: Words of a shingle, least Jaccard similarity of the sets.
WIDE_SHINGLE, SIMILARITY = 5, 0.8


class Layout(NamedTuple):
    """How a wide fingerprint is cut: segments of so many bits, of which the `uncertain` ones whose counts are nearest to a
    half are tried flipped, up to `flips` at once."""

    segments: int
    bits: int
    uncertain: int
    flips: int

    @property
    def parts(self) -> int:
        """64-bit words of a fingerprint."""
        return -(-self.segments * self.bits // 64)

    @property
    def variants(self) -> int:
        """Keys of one text in one segment."""
        return sum(math.comb(self.uncertain, k) for k in range(self.flips + 1))

    @property
    def chance(self) -> float:
        """The expected number of entries in which two unrelated texts meet."""
        return self.segments * self.variants**2 / 2.0**self.bits

    @property
    def never(self) -> int:
        """Differing bits beyond which a pair isn't similar: at 0.8 about 15.4 % of the bits differ, and of 384 bits 90 are more than
        four standard deviations above that."""
        return self.parts * 15


#: Each has about 95 % of the lone pairs at a similarity of 0.8 as candidates (simulated, see README), more above.
LAYOUTS = (Layout(13, 28, 4, 2), Layout(13, 32, 6, 2), Layout(15, 36, 6, 3), Layout(12, 40, 8, 3), Layout(18, 44, 8, 3), Layout(27, 48, 8, 3))
#: Texts of one block of a large table entry; blocks are compared two by two.
BLOCK = 512


def layout_for(texts: int) -> Layout:
    """The layout with the least rows a text: its keys and, twice over, its chance meetings with all others."""
    return min(LAYOUTS, key=lambda x: x.segments * x.variants + 2 * x.chance * texts)


def _wide(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Margins of 64 * parts bits, each part from another mix of the distinct hashes."""
    distinct = np.unique(hashes)
    return np.concatenate([margins(mix(distinct * np.uint64(2 * k + 1) + np.uint64(k))) for k in range(parts)])


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text or b"", WIDE_SHINGLE)]))


def _wide_marks(docs: DataFrame, layout: Layout) -> DataFrame:
    """(id, k2, k3, k1, f0.., low), written: for each distinct text (k2, k3: its hash of 128 bits) a number of its own, the least doc_id,
    its wide fingerprint, and the places of its segments' least certain bits."""
    names = [f"f{k}" for k in range(layout.parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            m = np.stack([_wide(shingle_set(t), layout.parts) for t in b.column("text").cast(pa.binary()).to_pylist()])
            parts = np.packbits(m > 0, axis=1).reshape(len(m), layout.parts, 8).view(">i8")[:, :, 0].astype(np.int64)
            segments = np.abs(m[:, : layout.segments * layout.bits]).reshape(len(m), layout.segments, layout.bits)
            low = np.argsort(segments, axis=2, kind="stable")[:, :, : layout.uncertain].astype(np.uint8).reshape(len(m), -1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2", "k3")), *[pa.array(np.ascontiguousarray(parts[:, k])) for k in range(layout.parts)], pa.array([r.tobytes() for r in low], pa.binary())], ["k1", "k2", "k3", *names, "low"])

    k2, k3 = keys128("text")
    marks = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k1"), k2.alias("k2"), k3.alias("k3"), "text").mapInArrow(run, "k1 long, k2 long, k3 long, " + ", ".join(f"{c} long" for c in names) + ", low binary")
    one = marks.groupBy("k2", "k3").agg(F.min("k1").alias("k1"), *[F.first(c).alias(c) for c in (*names, "low")])
    return materialize(one.select(F.monotonically_increasing_id().alias("id"), "k2", "k3", "k1", *names, "low"), "wide")


def _keys(marks: DataFrame, layout: Layout, *carried: str) -> DataFrame:
    """(key, id, carried columns of longs): for each segment its value with up to `flips` of its least certain bits flipped: the part of the
    segment's Hamming ball in which near copies lie. Both sides enumerate, so two texts meet if the bits in which their segments
    differ are uncertain in one of them, `flips` in each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(layout.bits - 1, -1, -1, dtype=np.int64)
        chosen = (np.arange(1 << layout.uncertain)[:, None] >> np.arange(layout.uncertain)) & 1
        chosen = chosen[chosen.sum(1) <= layout.flips]
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                n = part.num_rows
                words = np.stack([part.column(1 + k).to_numpy() for k in range(layout.parts)], 1).astype(">i8")
                bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(n, -1), axis=1)[:, : layout.segments * layout.bits].reshape(n, layout.segments, layout.bits)
                low = np.frombuffer(b"".join(part.column(1 + layout.parts).to_pylist()), np.uint8).reshape(n, layout.segments, layout.uncertain)
                values = bits @ weight
                keys = values[:, :, None] ^ (weight[low] @ chosen.T)
                keys += (np.arange(layout.segments, dtype=np.int64) << layout.bits)[None, :, None]
                rest = [pa.array(np.repeat(part.column(k).to_numpy(), layout.segments * len(chosen))) for k in (0, *range(2 + layout.parts, part.num_columns))]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *rest], ["key", "id", *carried])

    columns = ["id", *[f"f{k}" for k in range(layout.parts)], "low", *carried]
    return marks.select(*columns).mapInArrow(run, ", ".join(f"{c} long" for c in ("key", "id", *carried)))


def _candidates(marks: DataFrame, layout: Layout) -> DataFrame:
    """(a, b): pairs of one table entry, verified by their whole distance, that unite what all texts of an entry linked to its first
    unite; _open_pairs compares what is left apart. The first is a partial aggregate joined back, so that an entry with
    many texts is split among tasks.

    A text of a large family meets other firsts in most of its entries, so it is linked to the least of them alone. Of the
    other pairs only those are verified that this leaves apart, and one of them stays for each two groups: what goes on
    has about a row a text, not one for each of its keys.
    """
    keys = _keys(marks, layout)
    entries = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # the planner doesn't know how many keys a text has and would gather them in the driver, to broadcast them
    met = keys.hint("merge").join(entries.hint("merge"), "key").filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    pairs = materialize(met, "pairs")
    least = materialize(_verified(pairs.groupBy("b").agg(F.min("a").alias("a")), marks, layout), "least")
    roots = materialize(_rooted(marks.select("id"), components(least)), "roots")
    a_root = pairs.join(roots.select(F.col("id").alias("a"), F.col("root").alias("r")), "a")
    apart = a_root.join(roots.select(F.col("id").alias("b"), F.col("root").alias("q")), "b").filter("r <> q")
    near = _verified(apart, marks, layout, "r", "q")
    bridges = near.groupBy(F.least("r", "q").alias("r"), F.greatest("r", "q").alias("q")).agg(F.min(F.struct("a", "b")).alias("x"))
    return least.union(bridges.select("x.a", "x.b"))


def _verified(pairs: DataFrame, marks: DataFrame, layout: Layout, *carried: str) -> DataFrame:
    """(a, b, carried columns) of the pairs within layout.never bits."""
    names = [f"f{k}" for k in range(layout.parts)]
    one = marks.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names])
    two = marks.select(F.col("id").alias("b"), *names)
    bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"a_{c}"))) for c in names), F.lit(0))
    return pairs.join(one, "a").join(two, "b").filter(bits <= layout.never).select("a", "b", *carried)


def _open_pairs(marks: DataFrame, layout: Layout) -> DataFrame:
    """(a, b): pairs within layout.never bits of one table entry whose texts have different roots (column root of marks), as many as
    unite what all unite.

    An entry whose texts have one root is settled. Others are dealt into blocks of about BLOCK texts by hash, and each
    pair of blocks is compared by whole distance in one place, so no task holds more than two blocks, and rows grow with
    the texts of an entry, not with their pairs.
    """
    names = [f"f{k}" for k in range(layout.parts)]
    keys = _keys(marks, layout, "root")
    mixed = keys.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = keys.hint("merge").join(mixed.select("key", blocks.alias("blocks")).hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id").join(marks.select("id", "root", *names), "id")
    placed = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own").select("key", "i", "j", "own", "id", "root", *names)

    def compared(m: np.ndarray) -> np.ndarray:
        """Rows (a, b) of two blocks' rows (own, id, root, fingerprint)."""
        own, ids, root, words = m[:, 0], m[:, 1], m[:, 2], m[:, 3:].view(np.uint64)
        two = np.searchsorted(own, own[-1])  # if blocks differ, only pairs between them: the rest is compared elsewhere
        x, y = (slice(0, two), slice(two, len(m))) if two else (slice(0, len(m)), slice(0, len(m)))
        bits = np.zeros((x.stop - x.start, y.stop - y.start), np.int16)
        for k in range(layout.parts):
            bits += np.bitwise_count(words[x, k][:, None] ^ words[y, k][None, :])
        a, b = np.nonzero((bits <= layout.never) & (root[x][:, None] != root[y][None, :]))
        a, b = a + x.start, b + y.start
        label = np.unique(root, return_inverse=True)[1].reshape(-1)
        keep, _ = forest(label[a], label[b], int(label.max()) + 1)
        return np.sort(np.stack([ids[a[keep]], ids[b[keep]]], 1), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        found, size = [], 0

        def out() -> pa.RecordBatch:
            rows = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(2)], ["a", "b"])

        def settle() -> None:
            nonlocal size
            m = held[0] if len(held) == 1 else np.concatenate(held)
            # blocks i and j differ, but all texts here are of one of them: nothing to compare
            if len(m) > 1 and not (now[1] != now[2] and m[0, 0] == m[-1, 0]):
                found.append(compared(m))
                size += len(found[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)
            cut = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)]))
            for begin, end in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True):
                if held and now != tuple(rows[begin, :3]):
                    settle()
                    held = []
                    if size > 1 << 16:
                        yield out()
                        found, size = [], 0
                now = tuple(rows[begin, :3])
                held.append(rows[begin:end, 3:])
        if held:
            settle()
        if size:
            yield out()

    return placed.mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, marks: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s), written: the sets of shingles of these texts (column id, distinct). Each is read from the rows with its least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingle_set(t).view(np.int64) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    wanted = marks.select("id", "k1", "k2", "k3").join(ids, "id", "left_semi")
    k2, k3 = keys128("text")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k1"), k2.alias("k2"), k3.alias("k3"), "text")
    texts = rows.join(wanted, ["k1", "k2", "k3"]).select("id", "text").dropDuplicates(["id"])
    return materialize(texts.mapInArrow(run, "id long, s array<long>"), "shingles")


def _exact_links(placed: DataFrame) -> DataFrame:
    """(a, b): links between texts at a Jaccard similarity of SIMILARITY or more, as many as unite what all unite, of texts (family, i, j,
    own, id, s: its set of shingles) in order of family and pair of blocks. Intersections of sets are products of 0/1 matrices over the
    shingles that stand in two sets or more."""

    def compared(parted: bool, own: np.ndarray, ids: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        two = int(np.searchsorted(own, own[-1])) if parted else 0
        x, y = (slice(0, two), slice(two, len(own))) if parted else (slice(0, len(own)), slice(0, len(own)))
        if len(own) < 2 or (parted and not two):
            return np.zeros((0, 2), np.int64)
        size = np.array(list(map(len, sets)), np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, which, seen = np.unique(flat, return_inverse=True, return_counts=True)
        shared = seen[which] > 1
        column, owner = (np.cumsum(seen > 1) - 1)[which[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((x.stop - x.start, y.stop - y.start), np.float32)
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            part = slice(*np.searchsorted(column, [k, k + 4096]))
            ones = np.zeros((len(sets), 4096), np.float32)
            ones[owner[part], column[part] - k] = 1
            both += ones[x] @ ones[y].T
        hit = both >= SIMILARITY * (size[x][:, None] + size[y][None, :] - both.astype(np.float64))
        a, b = np.nonzero(hit)
        a, b = a + x.start, b + y.start
        keep, _ = forest(a, b, len(ids))
        return np.stack([ids[a[keep]], ids[b[keep]]], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def settle() -> pa.RecordBatch:
            own, ids = (np.concatenate([h[k] for h in held]) for k in range(2))
            links = compared(now[1] != now[2], own, ids, [s for h in held for s in h[2]])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, k])) for k in range(2)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            lists = batch.column(5)
            flat, offs = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
                if held and now != tuple(keys[i].tolist()):
                    yield settle()
                    held = []
                now = tuple(keys[i].tolist())
                held.append((*(batch.column(k).slice(i, j - i).to_numpy() for k in (3, 4)), [flat[offs[k] : offs[k + 1]].copy() for k in range(i, j)]))
        if held:
            yield settle()

    return placed.mapInArrow(run, "a long, b long")


def _family_links(docs: DataFrame, marks: DataFrame, families: DataFrame, block: int = BLOCK, shingles: int = 4 << 20) -> DataFrame:
    """(a, b): links at SIMILARITY or more between the texts of each family (families: id, family), as many as unite what all unite.

    A family is dealt into blocks of about `block` texts and at most about `shingles` shingles by hash, and each pair of
    blocks is compared exactly in one place. Work grows with the square of a family, rows out with its blocks.
    """
    found = _sets(docs, marks, families.select("id")).join(families, "id")
    need = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("s")) / shingles)).cast("int")
    dealt = found.join(found.groupBy("family").agg(need.alias("blocks")), "family").withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "s")
    return _exact_links(placed.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "own"))


def near_copy_groups(docs: DataFrame, layout: Layout | None = None) -> DataFrame:
    """(id, k2, k3, k1, root): each distinct text (k2, k3: its hash of 128 bits, k1: its least doc_id) and the group that it belongs to by
    similarity of five-word shingles of at least SIMILARITY.

    Wide fingerprints of the distinct shingles (A-Z in lower case) are cut into segments; each segment's least certain
    bits are enumerated, and table matches are verified by whole distance: first each entry's texts with its first, then
    all with all where that leaves an entry's texts apart. What is near enough forms families, in which all texts are
    compared by their sets; only that decides. The layout follows from the number of rows. Of pairs at a similarity of 0.8
    about 95 % become candidates by themselves (simulated), of more similar ones more. Null and blank texts, which have no
    shingle, are one group; texts of fewer than five words are one shingle.
    """
    layout = layout or layout_for(docs.count())
    marks = _wide_marks(docs, layout)
    near = materialize(_candidates(marks, layout), "candidates")
    rooted = materialize(_rooted(marks, components(near)), "rooted")
    near = near.union(materialize(_open_pairs(rooted, layout), "more"))
    families = materialize(components(near).toDF("id", "family"), "families")
    return _rooted(marks, components(_family_links(docs, marks, families))).select("id", "k2", "k3", "k1", "root")


def _rooted(marks: DataFrame, roots: DataFrame) -> DataFrame:
    """marks with the root of each text, itself where it has no link."""
    return marks.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each group of near_copy_groups one row of its least doc_id stays (null ids last, ties by hash of
    the text; of rows equal in both any one). Other columns are kept, whatever their names; an empty table stays empty."""
    names = spare(docs, "k1", "k2", "k3")
    k2, k3 = keys128("text")
    least = near_copy_groups(docs).groupBy("root").agg(F.min(F.struct("k1", "k2", "k3")).alias("x"))
    stay = least.select(*[F.col(f"x.{c}").alias(n) for c, n in zip(("k1", "k2", "k3"), names, strict=True)])
    keyed = docs.withColumns(dict(zip(names, (F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), k2, k3), strict=True)))
    return keyed.dropDuplicates(names).join(stay, names, "left_semi").select(*docs.columns)
