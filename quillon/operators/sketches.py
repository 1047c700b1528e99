"""MinHash sketches and band keys."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


# Lanes, hash constants, bands of lanes, and the ladder's limits.
LANES = 128
FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193
LANE_A, LANE_B = 0x9E3779B1, 0x85EBCA6B
BANDS = 16
NEAR, ADAPT = 0.8, 0.6
#: Shingles that meet all lanes at once.
STEP = 4096


def fnv1a(words: list[str]) -> np.ndarray:
    """32-bit hashes of ASCII strings, column by column of the padded letters."""
    raw = [w.encode("ascii") for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    width = int(size.max(initial=0))
    letters = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width)
    h = np.full(len(raw), FNV_START, np.uint32)
    for j in range(width):
        h = np.where(size > j, (h ^ letters[:, j]) * np.uint32(FNV_PRIME), h)
    return h


def sketch_of(words: list[str]) -> np.ndarray:
    """Least hash of each lane; all ones without shingles."""
    k = np.arange(1, LANES + 1, dtype=np.uint32)
    a, b = k * np.uint32(LANE_A) | np.uint32(1), k * np.uint32(LANE_B)
    out = np.full(LANES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(words), STEP):
        out = np.minimum(out, (fnv1a(words[lo : lo + STEP])[:, None] * a + b).min(0))
    return out


def shingles_of(text: str | None, n: int = 4) -> list[str]:
    """The shingles of ``scores.shingles``, where a row is in Python anyhow."""
    t = [x for x in re.split("[^a-z0-9]+", (text or "").lower()) if x]
    if len(t) < n:
        return [" ".join(t)] if t else []
    return list(dict.fromkeys(" ".join(t[i : i + n]) for i in range(len(t) - n + 1)))


@F.pandas_udf(ArrayType(LongType()))
def _sketch(s: pd.Series) -> pd.Series:
    return s.map(lambda t: sketch_of(shingles_of(t)).astype(np.int64))


def sketch(text: Column) -> Column:
    return _sketch(F.coalesce(text, F.lit("")))


def agreement(a: str, b: str) -> Column:
    """Share of equal lanes: an estimate of the Jaccard similarity."""
    return F.size(F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda p: p["x"] == p["y"])) / LANES


def band_keys(sk: str) -> Column:
    rows = LANES // BANDS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.concat(b.cast("string"), F.lit(":"), F.substring(F.sha2(F.array_join(F.slice(F.col(sk), b * rows + 1, F.lit(rows)), ","), 256), 1, 16)))
