"""Hashes that Catalyst has no form for: canonical JSON and FNV-1a, as Arrow UDFs."""

from __future__ import annotations

import hashlib
import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])


def canonical_json(text: str) -> str:
    """Keys in order, no spaces, ASCII escapes."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


@F.pandas_udf(StringType())
def canonical_hash(texts: pd.Series) -> pd.Series:
    """STR-12, STR-13, STR-15: sha256 of a JSON text's canonical form; null for what isn't JSON."""

    def one(t):
        try:
            return None if t is None else "sha256:" + hashlib.sha256(canonical_json(t).encode()).hexdigest()
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(StringType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """STR-18: FNV-1a, 64 bits, as 16 hex digits; all rows of a batch advance one byte at a time in numpy."""
    import numpy as np

    raw = [b"" if t is None else t.encode() for t in texts]
    lens = np.array([len(r) for r in raw])
    out = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-lens, kind="stable")
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    starts, live = (np.cumsum(lens) - lens)[order], lens[order]
    for k in range(int(lens.max(initial=0))):
        n = int(np.searchsorted(-live, -k, "left"))  # rows longer than k
        rows = order[:n]
        out[rows] = (out[rows] ^ data[starts[:n] + k]) * np.uint64(0x100000001B3)
    return pd.Series([None if t is None else f"{int(h):016x}" for t, h in zip(texts, out, strict=True)])
