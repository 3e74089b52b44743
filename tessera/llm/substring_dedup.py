"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The reference is the whole corpus, kept in blocks by anchor: the anchor of a window (WINDOW words in sequence) is the
least hash of its GRAM-word sequences, so equal windows have equal anchors, and a document need be factored against no
block but those of its own anchors. First the anchors alone are counted; only stretches of words whose anchor stands at
two or more places of the corpus are read again and sent to their block.

A block indexes the words of its stretches in a suffix array. A stretch is factored greedily: the factor at a place is
its longest match at one other place of the block, found word by word; one of WINDOW words or more is a duplicate span.
The next factor begins with the first window that crosses this one's end, so that a window across factor boundaries is
checked by itself; a window across the edge of a stretch belongs to the next stretch and is checked in that one's block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, cut_at_spaces, discard, extended, keys128, materialize, slices, spare
from .words import Words, gram_hashes, slide_min, word_hashes, words_of

WINDOW, GRAM = 35, 12
#: Words of the blocks that are indexed at once.
HELD = 1_000_000
#: Places of one anchor above which its stretches are compared window by window, by a shuffle, and not in one block.
CROWDED = 1000
_SPACE = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")


class Runs(NamedTuple):
    words: Words
    anchors: np.ndarray  #: of each run: a maximal stretch of one text's windows with one anchor
    row: np.ndarray  #: its text's row
    first: np.ndarray  #: its first word, among all words
    place: np.ndarray  #: its first word, within its text
    windows: np.ndarray  #: its windows
    seen: np.ndarray  #: 2 if a chosen sequence stands twice within it, so that its windows may repeat each other; else 1


def _parts(batch: pa.RecordBatch, window: int) -> Iterator[tuple[pa.Array, int]]:
    """Texts of a batch (all of them; or a piece of a long one, which begins with the last windows' words of the piece before) and the
    number of words before the first."""
    texts = batch.column(batch.schema.get_field_index("text"))
    if len(texts) > 1 or not texts[0].is_valid or len(texts[0].as_buffer()) <= PIECE:
        yield texts, 0
        return
    carried: list[bytes] = []
    before = 0
    for piece in cut_at_spaces(texts[0].as_buffer().to_pybytes()):
        own = carried + [w for w in piece.translate(_SPACE).split(b" ") if w]
        yield pa.array([b" ".join(own)], pa.large_binary()).cast(pa.large_string()), before
        carried = own[max(0, len(own) - window + 1) :]
        before += len(own) - len(carried)


def _runs(texts: pa.Array, window: int, gram: int) -> Runs | None:
    words = words_of(texts)
    if len(words.which) < window:
        return None
    grams = gram_hashes(word_hashes(words), gram)
    least = slide_min(grams, window - gram + 1)
    ends = np.cumsum(words.counts)
    doc = np.repeat(np.arange(len(ends)), words.counts)[: len(least)]
    inside = np.arange(len(least)) + window <= ends[doc]
    ok = np.flatnonzero(inside)
    if not len(ok):
        return None
    # a place's sequence is chosen if it is the least of a window around it, that is, the greatest of these windows' least ones
    least[~inside] = 0
    room = np.zeros(window - gram, np.uint64)
    top = ~slide_min(~np.concatenate([room, least, room]), window - gram + 1)
    chosen = np.flatnonzero((top == grams[: len(top)]) & (top > 0))
    order = np.argsort(grams[chosen], kind="stable")
    same = grams[chosen[order[1:]]] == grams[chosen[order[:-1]]]
    again = np.full(len(grams) + 1, len(grams) + window)  # where a chosen sequence stands next
    again[chosen[order[:-1][same]]] = chosen[order[1:][same]]
    anchors, doc = least[ok], doc[ok]
    first = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])]))
    windows = np.diff(np.concatenate([first, [len(ok)]]))
    begin = ok[first]
    end = begin + windows + window - gram
    repeats = np.minimum.reduceat(again, np.stack([begin, end], 1).ravel())[::2] < end
    return Runs(words, anchors[first], doc[first], begin, begin - (ends - words.counts)[doc[first]], windows, 1 + repeats)


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, ka, n): each run's anchor, counted twice if the run may repeat itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            keys = b.column(0).to_numpy()
            for texts, _ in _parts(b, window):
                found = _runs(texts, window, gram)
                if found is None:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(found.anchors.view(np.int64)), pa.array(keys[found.row]), pa.array(found.seen.astype(np.int32))], ["anchor", "ka", "n"])

    return docs.select("ka", "text").mapInArrow(run, "anchor long, ka long, n int")


def _stretches(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, ka, kb, pos, words) of the runs of docs (ka, kb, anchors, text) whose anchor is among the text's listed ones: words are
    those of all windows, joined by one space."""

    def marked(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return anchors ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ka, kb, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            wanted = marked(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), sizes))
            for texts, before in _parts(b, window):
                found = _runs(texts, window, gram)
                if found is None:
                    continue
                hit = np.flatnonzero(np.isin(marked(found.anchors, found.row), wanted))
                size = found.windows[hit] + window - 1
                for x in range(0, len(hit), 1 << 14):
                    at, n = hit[x : x + (1 << 14)], size[x : x + (1 << 14)]
                    ends = np.cumsum(n)
                    index = np.arange(ends[-1]) + np.repeat(found.first[at] - (ends - n), n)
                    each = found.words.distinct.take(pa.array(found.words.which[index]))
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), each), pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(found.anchors[at].view(np.int64)), pa.array(ka[found.row[at]]), pa.array(kb[found.row[at]]), pa.array(found.place[at] + before), joined], ["anchor", "ka", "kb", "pos", "words"])

    return docs.select("ka", "kb", "anchors", "text").mapInArrow(run, "anchor long, ka long, kb long, pos long, words binary")


class Factors(NamedTuple):
    stretch: np.ndarray  #: which stretch
    begin: np.ndarray  #: its first word there
    length: np.ndarray  #: its words
    source: np.ndarray  #: the stretch that it is copied from (another copy of itself if that is the same one at the same place)
    source_begin: np.ndarray  #: where in that one


def factors(stretches: pa.Array, copies: np.ndarray, window: int = WINDOW) -> Factors:
    """The greedy factors of `window` words or more of each stretch, against all places of the same block, by their very words.

    stretches: words joined by one space, distinct; copies: how often each stands in the corpus. Suffixes that begin a
    window are sorted by prefix doubling over numbered words (each stretch ends in a number of its own), so that a
    suffix's longest match is with a neighbour in that order; of a match beyond 64 words 64 to 95 may be taken, and the next factor goes on from there.
    """
    words = words_of(stretches.cast(pa.large_binary()).cast(pa.large_string()))
    counts, n = words.counts, len(words.counts)
    starts = np.cumsum(counts + 1) - (counts + 1)
    total = int((counts + 1).sum())
    base = np.empty(total, np.int64)
    stretch_of = np.repeat(np.arange(n), counts + 1)
    closing = starts + counts
    inner = np.ones(total, bool)
    inner[closing] = False
    base[inner], base[closing] = words.which, len(words.distinct) + np.arange(n)
    ranks, size = {1: np.unique(base, return_inverse=True)[1]}, 1
    while size < 32:
        r = ranks[size]
        ranks[2 * size] = np.unique(r * (total + 1) + np.concatenate([r[size:], np.zeros(min(size, total), np.int64)])[:total], return_inverse=True)[1]
        size *= 2
    windows = np.maximum(counts - window + 1, 0)
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    last = total - 1
    order = at[np.lexsort((ranks[32][np.minimum(at + 32, last)], ranks[32][at]))]
    one, two = order[:-1], order[1:]
    common = np.zeros(len(one), np.int64)
    for k in (32, 32, 16, 8, 4, 2, 1):
        common += k * (ranks[k][np.minimum(one + common, last)] == ranks[k][np.minimum(two + common, last)])
    longest, source = np.zeros(total, np.int64), np.zeros(total, np.int64)
    longest[two], source[two] = common, one
    better = common > longest[one]
    longest[one[better]], source[one[better]] = common[better], two[better]
    again = copies[stretch_of] > 1
    longest[again], source[again] = (closing[stretch_of] - np.arange(total))[again], np.flatnonzero(again)
    # from each place the next one whose factor is long enough; all stretches step from factor to factor together
    able = np.full(total + 1, total)
    able[at[longest[at] >= window]] = at[longest[at] >= window]
    able = np.minimum.accumulate(able[::-1])[::-1]
    now, found = starts[windows > 0], []
    while len(now):
        end = closing[stretch_of[now]]
        now = able[now]
        now = now[now < end]
        if len(now):
            found.append(now)
            now = now + longest[now] - window + 1
    begin = np.concatenate(found) if found else np.zeros(0, np.int64)
    here, there = stretch_of[begin], stretch_of[source[begin]]
    return Factors(here, begin - starts[here], longest[begin], there, source[begin] - starts[there])


def _parse(blocks: DataFrame, window: int, held: int) -> DataFrame:
    """(ka, kb, pos, stop): the factors of stretches (anchor, ka, kb, pos, words), which come in order of anchor, as spans of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[pa.RecordBatch] = []
        size = 0

        def parsed() -> pa.RecordBatch:
            table = pa.Table.from_batches(chunk).combine_chunks()
            coded = table.column("words").combine_chunks().dictionary_encode()
            which = coded.indices.to_numpy()
            # blocks that are indexed together cannot match each other: equal windows have equal anchors
            f = factors(coded.dictionary, np.bincount(which, minlength=len(coded.dictionary)), window)
            order = np.argsort(f.stretch, kind="stable")
            per = np.bincount(f.stretch, minlength=len(coded.dictionary))
            first, n = (np.cumsum(per) - per)[which], per[which]
            place = np.repeat(np.arange(len(which)), n)
            own = order[np.arange(len(place)) + np.repeat(first - (np.cumsum(n) - n), n)]
            pos = table.column("pos").to_numpy()[place] + f.begin[own]
            return pa.RecordBatch.from_arrays([*(pa.array(table.column(c).to_numpy()[place]) for c in ("ka", "kb")), pa.array(pos), pa.array(pos + f.length[own])], ["ka", "kb", "pos", "stop"])

        for b in batches:
            if not b.num_rows:
                continue
            a = b.column(0).to_numpy()
            bytes_ = pc.binary_length(b.column(4)).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(a)], strict=True):
                if chunk and size >= held * 6 and chunk[-1].column(0)[-1].as_py() != a[i]:
                    yield parsed()
                    chunk.clear()
                    size = 0
                chunk.append(b.slice(i, j - i))
                size += int(bytes_[i:j].sum())
        if chunk:
            yield parsed()

    return blocks.select("anchor", "ka", "kb", "pos", "words").mapInArrow(run, "ka long, kb long, pos long, stop long")


def _crowded(stretches: DataFrame, window: int) -> DataFrame:
    """(ka, kb, pos, stop): each window of these stretches (anchor, ka, kb, pos, words) that stands at two or more places.

    Equal stretches and then equal windows are grouped by their words, with partial sums, so that no task holds all
    places of a common one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words", 1 << 18):
            for sa, sb, n, words in zip(*(b.column(c).to_pylist() for c in ("sa", "sb", "n", "words")), strict=True):
                each = words.split(b" ")
                for x in range(0, len(each) - window + 1, 4096):
                    own = [b" ".join(each[i : i + window]) for i in range(x, min(x + 4096, len(each) - window + 1))]
                    full = lambda v: pa.array(np.full(len(own), v, np.int64))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([full(sa), full(sb), pa.array(np.arange(x, x + len(own))), full(n), pa.array(own, pa.binary())], ["sa", "sb", "begin", "n", "words"])

    sa, sb = keys128("words")
    distinct = stretches.groupBy("words").agg(F.count("*").alias("n")).select(sa.alias("sa"), sb.alias("sb"), "n", "words")
    each = materialize(distinct.mapInArrow(run, "sa long, sb long, begin long, n long, words binary"), "crowded")
    # written, so that the join below is free to split a common window among tasks
    often = materialize(each.groupBy("words").agg(F.sum("n").alias("seen")).filter("seen > 1").select("words"), "often")
    found = each.join(often, "words", "left_semi").select("sa", "sb", "begin")
    places = stretches.select(sa.alias("sa"), sb.alias("sb"), "ka", "kb", "pos").join(found, ["sa", "sb"])
    return places.select("ka", "kb", (F.col("pos") + F.col("begin")).alias("pos"), (F.col("pos") + F.col("begin") + window).alias("stop"))


def _spans(docs: DataFrame, window: int, gram: int, held: int, crowded: int) -> DataFrame:
    """(ka, kb, spans): the duplicate spans of each text of docs (ka, kb, text) that has any, as first and end words."""
    docs = docs.filter(F.length("text") >= 2 * window - 1)
    places = materialize(_anchors(docs, window, gram), "places")
    often = places.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    lists = places.join(often, "anchor", "left_semi").groupBy("ka").agg(F.collect_set("anchor").alias("anchors"))
    stretches = materialize(_stretches(docs.join(lists, "ka"), window, gram), "stretches", "zstd")
    sizes = stretches.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes"))
    full = materialize(sizes.filter((F.col("n") > crowded) | (F.col("bytes") > 60 * held)).select("anchor"), "full")
    crowds = not full.isEmpty()
    few = stretches.join(full, "anchor", "left_anti") if crowds else stretches
    spans = _parse(few.repartition("anchor").sortWithinPartitions("anchor"), window, held)
    if crowds:
        spans = spans.union(_crowded(stretches.join(full, "anchor", "left_semi"), window))
    spans = materialize(spans.distinct().groupBy("ka", "kb").agg(F.collect_list(F.struct("pos", "stop")).alias("spans")), "spans")
    discard(stretches)
    return spans


def strip_spans(raw: bytes, pos: np.ndarray, stop: np.ndarray) -> tuple[bytes, int, int, str]:
    """A text's words outside the spans, joined by one space; how many it had and lost; the sha256 of what is left. Works in pieces."""
    order = np.argsort(pos, kind="stable")
    pos, reach = pos[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    kept, before, lost, sha = [], 0, 0, hashlib.sha256()
    for piece in cut_at_spaces(raw):
        words = [w for w in piece.translate(_SPACE).split(b" ") if w]
        if len(pos):
            place = np.arange(before, before + len(words))
            of = np.searchsorted(pos, place, "right") - 1
            keep = (of < 0) | (reach[np.maximum(of, 0)] <= place)
            lost += len(words) - int(keep.sum())
            own = [words[i] for i in np.flatnonzero(keep).tolist()]
        else:
            own = words
        before += len(words)
        if own:
            joined = b" ".join(own)
            sha.update(b" " + joined if kept else joined)
            kept.append(joined)
    return b" ".join(kept), before, lost, sha.hexdigest()


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, held: int = HELD, crowded: int = CROWDED) -> DataFrame:
    """docs with text without its duplicate spans, n_words, n_removed (long) and kept_sha256.

    Words are runs of bytes other than 0x20, 0x09 to 0x0D; every word of a window of `window` words whose sequence
    starts at two or more places of docs (whole texts, any documents, the same one included) is removed, at all of its
    places. A text that loses nothing stays as it is; any other becomes its kept words, joined by one space. A null
    text has no words and stays null; repeated rows are copies of each other. kept_sha256 is of the kept words joined
    by one space. Rows are told apart by 128 bits of doc_id and text, null ids included. A long text is read in pieces,
    so beside itself it takes bounded memory. Other columns are kept, whatever their names; columns of docs with the
    names of results are replaced. An empty table stays empty.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    names = docs.columns
    ka, kb, own = spare(docs, "ka", "kb", "spans")
    keyed = docs.withColumns(dict(zip((ka, kb), keys128("doc_id", "text"), strict=True)))
    spans = _spans(keyed.select(F.col(ka).alias("ka"), F.col(kb).alias("kb"), "text"), window, gram, held, crowded)
    joined = keyed.join(spans.select(F.col("ka").alias(ka), F.col("kb").alias(kb), F.col("spans").alias(own)), [ka, kb], "left")
    schema = extended(docs, n_words="long", n_removed="long", kept_sha256="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in slices(batches, "text"):
            texts, n_words, n_removed, shas = [], [], [], []
            col, spans = b.column(b.schema.get_field_index("text")), b.column(len(names))
            for k, t in enumerate(col.cast(pa.large_binary()).to_pylist()):
                s = spans.slice(k, 1).flatten() if spans[k].is_valid else None
                left, n, lost, sha = strip_spans(t or b"", s.field("pos").to_numpy() if s else none, s.field("stop").to_numpy() if s else none)
                texts.append(left if lost else t)
                n_words.append(n)
                n_removed.append(lost)
                shas.append(sha)
            new = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(col.type)
            yield pa.RecordBatch.from_arrays([new if c == "text" else b.column(i) for i, c in enumerate(names)] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas)], [*names, "n_words", "n_removed", "kept_sha256"])

    return joined.select(*names, own).mapInArrow(run, schema)
