"""Language identification: several centroids a language over normalised TF-IDF vectors of byte n-grams, nearest by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, extended, slices

DIMS, GRAMS, CENTROIDS = 4096, (2, 3), 3
#: Documents of each language that are fitted on at most and of all languages together (the bound on what the driver gets).
MOST_PER_LANGUAGE, MOST = 800, 8000
#: Characters of a text that is fitted on at most.
LONGEST = 200_000
_TABLE = np.full(256, 0x20, np.uint8)
_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE[0x80:] = np.arange(0x80, 0x100)


def counts_of(texts: pa.Array, piece: int = 1 << 20) -> np.ndarray:
    """Hashed n-gram counts (float32, texts x DIMS) of lower-case letters; everything else in ASCII counts as a space.

    N-grams are counted by pieces of the bytes that they begin in, so a long text takes little beside itself.
    """
    low = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    offs = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    raw = np.frombuffer(low.buffers()[2], np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    out = np.zeros(len(low) * DIMS)
    for x in range(0, len(raw), piece):
        size = min(piece, len(raw) - x)
        data = _TABLE[raw[x : x + size + max(GRAMS) - 1]]
        place = np.arange(x, x + size)
        row = np.searchsorted(offs, place, "right") - 1
        wide, room = data.astype(np.uint32), offs[row + 1] - place
        spaces = data == 0x20
        for n in GRAMS:
            m = min(size, len(data) - n + 1)
            if m <= 0:
                continue
            h, blank = np.full(m, n, np.uint32), np.zeros(m, bool)
            for k in range(n):
                h = (h ^ wide[k : k + m]) * np.uint32(0x01000193)
                if k:
                    blank |= spaces[k : k + m] & spaces[k - 1 : k - 1 + m]
            h ^= h >> np.uint32(15)
            ok = np.flatnonzero((room[:m] >= n) & ~blank)
            first = row[0]
            counted = np.bincount((row[ok] - first) * DIMS + (h[ok] % DIMS))
            out[first * DIMS : first * DIMS + len(counted)] += counted
    return out.reshape(len(low), DIMS).astype(np.float32)


class Model(NamedTuple):
    idf: np.ndarray  #: DIMS
    centroids: np.ndarray  #: DIMS x all centroids, of length one
    languages: list[str]  #: the language of each centroid
    least: float  #: a nearest cosine below this is rejected


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(texts: pa.Array, languages: list[str], centroids: int = CENTROIDS, seed: int = 5) -> Model:
    """Spherical k-means within each language; the rejection bound is half the least similarity but for 1 in 1000 of the fitted."""
    counts = counts_of(texts)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = vectors(counts, idf)
    names, found = np.array(languages), []
    rng = np.random.default_rng(seed)
    for name in sorted(set(languages)):
        own = x[names == name]
        c = own[rng.choice(len(own), min(centroids, len(own)), replace=False)]
        for _ in range(12):
            near = (own @ c.T).argmax(1)
            c = np.stack([own[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        found += [(name, v) for v in c]
    all_ = np.stack([v for _, v in found], 1) if found else np.zeros((DIMS, 0), np.float32)
    least = 0.5 * float(np.quantile((x @ all_).max(1), 0.001)) if found and len(x) else 0.0
    return Model(idf, all_.astype(np.float32), [name for name, _ in found], least)


def fit_languages(docs: DataFrame, most_per_language: int = MOST_PER_LANGUAGE) -> Model:
    """Fit on documents with text and lang whose crc32(doc_id as text) mod 4 is not 2.

    At most about most_per_language of each language and MOST of all are drawn, by hash at the rate of the bound over its
    count, so every run draws the same; a language with few documents gives them all. Texts above LONGEST characters are
    not fitted on, so the driver gets a bounded number of bytes too.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", 4) != 2) & (F.length("text") <= LONGEST))
    usable = usable.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = usable.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return fit(pa.array([], pa.string()), [])
    share = min(float(most_per_language), MOST / languages)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    # drawn by keys alone; about MOST of them at most are broadcast, and of rows of one doc_id and lang one is taken
    drawn = usable.select("doc_id", "lang").join(counts, "lang").filter(draw < share / F.col("count")).select("doc_id", "lang").distinct()
    one = usable.join(F.broadcast(drawn), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    got = one.select("doc_id", "x.text", "lang").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    return fit(got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string()), got.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, reject_as_und: bool = False) -> DataFrame:
    """docs with lang_pred, score (cosine of the nearest centroid, 0 to 1) and rejected, from the whole text alone.

    A null text or one without a letter is `und` with score 0. A text whose nearest centroid is too far is rejected: it
    keeps the nearest language, or is `und` too with reject_as_und. Without any learned language all texts are `und`.
    Repeated rows agree; a text of any length is read whole, in pieces. Other columns are kept, columns of docs with the
    names of results are replaced; an empty table stays empty.
    """
    kept = docs.drop("lang_pred", "score", "rejected")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            texts = b.column(b.schema.get_field_index("text"))
            letter = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if model.languages:
                for at in range(0, len(texts), 512):
                    sims = vectors(counts_of(texts.slice(at, 512)), model.idf) @ model.centroids
                    best[at : at + 512], score[at : at + 512] = sims.argmax(1), np.clip(sims.max(1), 0, 1)
            known = letter & bool(model.languages)
            far = known & (score < model.least)
            named = known & ~far if reject_as_und else known
            langs = [model.languages[k] if ok else "und" for k, ok in zip(best.tolist(), named.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(far)], [*names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, extended(kept, lang_pred="string", score="double", rejected="boolean"))
