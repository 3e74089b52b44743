"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, all hashed into one table, so an unseen
misspelling shares most of a known word's vectors. A stretch of SPAN words is the mean of its words, and a linear
softmax over that mean gives toxic or not. A document is as toxic as its most toxic stretch, so that length dilutes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, crc32_mod, cut_at_spaces, extended, slices
from .words import words_of

BUCKETS, DIMS, GRAMS, SPAN = 1 << 17, 8, (4, 6, 8), 8
DECAY = 1e-4
#: Labelled documents of each class that the model is fitted on at most (the bound on what the driver gets).
MOST_PER_CLASS = 1500
#: Characters of a text that is fitted on at most.
LONGEST = 200_000
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def subwords(words: pa.Array, at_once: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (int32) of all words' n-grams and their number a word, a bounded number of words at a time."""
    parts = [_subwords(words.slice(k, at_once)) for k in range(0, len(words), at_once)] or [_subwords(words)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character n-grams (bytes of the lower-case word between two marks) and their number a word."""
    clean = pc.utf8_trim(pc.utf8_lower(words), characters=PUNCTUATION)
    marked = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\x02", clean, "\x03", ""))).cast(pa.large_binary())
    offs = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offs[0] : offs[-1]].astype(np.uint64) if len(marked) else np.zeros(0, np.uint64)
    offs = offs - offs[0] if len(marked) else np.zeros(1, np.int64)
    word = np.repeat(np.arange(len(marked)), np.diff(offs))
    room = offs[1:][word] - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
    prime = np.uint64(0x100000001B3)
    keys, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(room >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ data[at + k]) * prime
        keys.append(h)
        owners.append(word[at])
    if len(data):  # the whole word: a position-weighted sum of its bytes
        place = np.arange(len(data)) - offs[:-1][word]
        weighted = (data + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * prime * (data + np.uint64(7)) * (place.astype(np.uint64) + np.uint64(11))
        keys.append(np.add.reduceat(weighted, offs[:-1]))
        owners.append(np.arange(len(marked)))
    h = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(own, kind="stable")
    h = h[order]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32), np.bincount(own, minlength=len(words))


class Model(NamedTuple):
    table: np.ndarray  #: BUCKETS x DIMS
    weights: np.ndarray  #: DIMS x 2
    bias: np.ndarray  #: 2

    def gains(self) -> np.ndarray:
        """What each bucket adds to the log odds of a stretch that consists of it alone."""
        return self.table @ (self.weights[:, 1] - self.weights[:, 0])


def _word_means(gains: np.ndarray, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(sizes):
        return np.zeros(0)
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(gains[buckets], starts) / sizes


def _stretches(counts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of each stretch (every half span, the last one whole if it can be) and stretches of each text."""
    step = max(1, span // 2)
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - span) // step)), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    base = (np.cumsum(counts) - counts)[doc]
    first = np.maximum(0, np.minimum(k * step, counts[doc] - span))
    return base + first, base + np.minimum(first + span, counts[doc]), n


def fit(texts: pa.Array, toxic: np.ndarray, epochs: int = 120, seed: int = 3) -> Model:
    """Full-batch gradient descent on table and softmax together. At first all stretches of a document speak for it, then its most toxic one."""
    words = words_of(texts)
    buckets, sizes = subwords(words.distinct)
    first, end, n = _stretches(words.counts, SPAN)
    there = n > 0
    y, starts = toxic[there].astype(float), (np.cumsum(n) - n)[there]
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32), rng.normal(0, 1.0, (DIMS, 2)), np.zeros(2))
    if not len(y) or y.min() == y.max():
        base = np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99)
        return Model(model.table * 0, model.weights, np.array([0.0, np.log(base / (1 - base))]))
    moments = [np.zeros_like(x) for x in model]
    of_word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.8
    doc = np.repeat(np.arange(len(y)), n[there])
    for epoch in range(epochs):
        delta = model.weights[:, 1] - model.weights[:, 0]
        per_word = _word_means((model.table @ delta).astype(np.float32), buckets, sizes).astype(np.float64)
        sums = np.concatenate([[0], np.cumsum(per_word[words.which])])
        z = (sums[end] - sums[first]) / (end - first)
        soft = 1.0 if epoch < epochs // 4 else 6.0 if epoch < epochs // 2 else 20.0
        top = np.maximum.reduceat(z, starts)
        share = np.exp(soft * (z - top[doc])) if epoch >= epochs // 8 else np.ones(len(z))
        share /= np.add.reduceat(share, starts)[doc]
        logit = np.add.reduceat(share * z, starts) + model.bias[1] - model.bias[0]
        wrong = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * balance / len(y)
        on_z = share * wrong[doc] / (end - first)
        edge = np.zeros(len(words.which) + 1)
        edge += np.bincount(first, on_z, len(edge)) - np.bincount(end, on_z, len(edge))
        on_word = np.bincount(words.which, np.cumsum(edge[:-1]), len(sizes)) / np.maximum(sizes, 1)
        on_gain = np.bincount(buckets, on_word.astype(np.float32)[of_word], BUCKETS)
        on_delta = model.table.T @ on_gain
        grads = Model(on_gain.astype(np.float32)[:, None] * delta.astype(np.float32)[None, :] + np.float32(DECAY) * model.table, np.stack([-on_delta, on_delta], 1), np.array([-wrong.sum(), wrong.sum()]))
        # Plain momentum, not Adam: a bucket seen in one document must not move as far as one seen in hundreds.
        for x, g, m, rate in zip(model, grads, moments, (50.0, 0.02, 0.02), strict=True):
            m *= 0.9
            m += g
            x -= np.float32(rate * (min(1.0, 5.0 / (rate * float(np.linalg.norm(m)) + 1e-12)) if rate > 1 else 1.0)) * m
    return model


def _stretch_best(texts: pa.Array, gains: np.ndarray) -> np.ndarray:
    """The log odds, but for the bias, of each text's most toxic stretch; texts without words: minus infinity."""
    words = words_of(texts)
    per_word = _word_means(gains, *subwords(words.distinct))
    sums = np.concatenate([[0], np.cumsum(per_word[words.which])])
    first, end, n = _stretches(words.counts, SPAN)
    best = np.full(len(n), -np.inf)
    if len(first):
        z = (sums[end] - sums[first]) / (end - first)
        best[n > 0] = np.maximum.reduceat(z, (np.cumsum(n) - n)[n > 0])
    return best


def score(texts: pa.Array, gains: np.ndarray, bias: float, piece: int = PIECE) -> np.ndarray:
    """Probability of label 1 for each text, from all its stretches; texts without words get the bias alone.

    A text longer than `piece` bytes is scored by pieces that end with a word, each begun with the SPAN - 1 words before;
    it is as toxic as its most toxic piece.
    """
    if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_buffer()) > piece:
        best, carried = np.full(1, -np.inf), b""
        for part in cut_at_spaces(texts[0].as_buffer().to_pybytes(), piece):
            own = carried + part
            best = np.maximum(best, _stretch_best(pa.array([own], pa.large_binary()).cast(pa.large_string()), gains))
            carried = b" ".join(own[-4096:].split()[-SPAN + 1 :]).decode("utf-8", "ignore").encode() + b" "
    else:
        best = _stretch_best(texts, gains)
    return 1 / (1 + np.exp(-np.clip(np.where(np.isinf(best), 0.0, best) + bias, -40, 40)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> Model:
    """Fit on labelled documents whose crc32(doc_id as text) mod 5 is not 0, most_per_class of each class at most.

    The sample is the same in every run: the rate of a class is its bound over its count, drawn by hash. Labels that
    contradict each other or are null are left out, texts above LONGEST characters are not fitted on, and of several texts
    of one doc_id one is, so the driver gets a bounded number of bytes; without labels of both kinds the model knows only
    the base rate.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc32_mod("doc_id", 5) != 0))
    one = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    counts = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") == 1, most_per_class / max(1, counts.get(1, 0))).otherwise(most_per_class / max(1, counts.get(0, 0)))
    sample = one.filter(draw < rate).select("doc_id", "toxic")
    fit_on = docs.filter(F.col("doc_id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) <= LONGEST)).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = fit_on.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))  # a doc_id may come more than once
    got = one.select("doc_id", "x.text", "toxic").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string()), got.column("toxic").to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5) for each whole text.

    Scores depend on nothing but the text: null and empty texts get the base score, repeated rows agree, a text of any
    length is read whole, in pieces. The sample that is fitted on, which the driver holds and broadcasts as ids, is bounded
    by most_per_class. Other columns are kept, columns of docs with the names of results are replaced; an empty table
    stays empty.
    """
    model = fit_toxicity(docs, labels, most_per_class)
    gains, bias = model.gains().astype(np.float32), float(model.bias[1] - model.bias[0])
    kept = docs.drop("score", "predicted")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = score(b.column(b.schema.get_field_index("text")), gains, bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return kept.mapInArrow(run, extended(kept, score="double", predicted="integer"))
