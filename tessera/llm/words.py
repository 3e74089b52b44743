"""Words of a batch of texts, numbered by Arrow: Python and numpy meet each distinct word of a batch once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    distinct: pa.Array  #: the batch's distinct words, large_string
    which: np.ndarray  #: the number of each word, texts one after the other
    counts: np.ndarray  #: words of each text


def words_of(texts: pa.Array) -> Words:
    """Words are runs of bytes other than 0x20 and 0x09 to 0x0D; a null text has none."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    cuts = split.offsets.to_numpy()
    coded = split.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
    which = np.asarray(coded.indices.to_numpy(), np.int64)
    real = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    there = real[which] if len(which) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(there)])
    return Words(coded.dictionary, which[there], np.diff(ends[cuts - cuts[0]]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word of the batch, in place order."""
    from xxhash import xxh64_intdigest

    own = np.fromiter(map(xxh64_intdigest, words.distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(words.distinct))
    return own[words.which] if len(words.which) else np.zeros(0, np.uint64)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """For each place i the hash of h[i : i + n]; the last n - 1 places have none. Doubling: log n passes."""
    base, out, done, power, size = 0x9E3779B97F4A7C15, None, 0, h, 1
    while True:
        if n & size:
            # what is done covers `done` places from i; power covers `size` places from i + done
            tail = power[done:]
            if out is None:
                out = tail
            else:
                k = min(len(out), len(tail))
                out = out[:k] * np.uint64(pow(base, size, 1 << 64)) + tail[:k]
            done += size
        if done == n:
            return mix(out[: max(0, len(h) - n + 1)])
        k = max(0, len(power) - size)
        power = power[:k] * np.uint64(pow(base, size, 1 << 64)) + power[size : size + k]
        size *= 2


def slide_min(v: np.ndarray, n: int) -> np.ndarray:
    """For each place i the least of v[i : i + n]."""
    out, size = v, 1
    while size * 2 <= n:
        out = np.minimum(out[: max(0, len(out) - size)], out[size:])
        size *= 2
    k = max(0, len(v) - n + 1)
    return np.minimum(out[:k], out[n - size : n - size + k])
