"""Randomness that depends on keys only: the same in every run, partitioning and engine that has md5."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: object, *keys: Column) -> Column:
    """A number in (0, 1) for each combination of keys."""
    whole = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return (F.conv(F.substring(whole, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def hash_key(seed: object, *keys: Column) -> Column:
    """A text by which to put things in a random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_streams(keys: np.ndarray, *salts: int) -> np.ndarray:
    """A 64-bit number for each key (a hash) and the salts, from which to draw."""
    x = keys.astype(np.int64).view(np.uint64)
    for salt in salts:
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt & 0xFFFFFFFFFFFFFFFF))
    return x


def stream_uniforms(streams: np.ndarray, draws: int) -> np.ndarray:
    """(streams, draws) of numbers in (0, 1)."""
    at = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return ((mixed(streams[:, None] + at) >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)
