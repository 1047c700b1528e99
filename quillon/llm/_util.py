"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass works on; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; one of this machine only where Spark runs on it alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/quillon-shared"


def stored_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = stored_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame, settle_: bool = True) -> None:
    """Remove the files of ``stored`` frames that nothing will read again, with the shuffle files of ended jobs."""
    spark = frames[0].sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for df in frames for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if settle_:
        settle(spark)


def settle(spark: SparkSession) -> None:
    """Let the driver's collectors see which jobs' shuffle files nothing refers to any more; Spark then deletes those.

    Python's dropped frames are released to the JVM by a thread of their own, so that is waited for (at most two seconds).
    """
    gc.collect()
    released = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    until = time.monotonic() + 2
    while released and time.monotonic() < until:
        time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.2)


def spans(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with at most about ``max_bytes`` of text; a longer text is a run by itself."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, lo = np.cumsum(size), 0
    while lo < len(size):
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + max_bytes, side="right")))
        yield lo, hi
        lo = hi


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) in runs of at most about ``max_bytes``; null is empty."""
    for lo, hi in spans(texts, max_bytes):
        yield lo, [t or b"" for t in texts[lo:hi].cast(pa.binary()).to_pylist()]


def trim() -> None:
    """Give this process's free memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def tidy(run):
    """A batch function that gives a reused worker's free memory back: what the tasks before left when it begins, and its own when it ends."""

    @functools.wraps(run)
    def tidied(batches):
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept by the worker up to a bounded length."""
    if len(_POWERS["up"]) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    made = {}
    for key, base in (("up", _BASE), ("down", _INVERSE)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        made[key] = np.cumprod(p, dtype=np.uint64)
    if n <= 4 * SLICE_BYTES:
        _POWERS.update(made)
    return made["up"], made["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift) on unsigned lanes."""
    x = x.astype(np.uint64, copy=True)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, 64-bit hash of each word) of A-Z-lower-cased texts."""
    return words_and_ends(texts)[:2]


def words_and_ends(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 64-bit hash, last two bytes as a number) of each word of A-Z-lower-cased texts.

    Words are runs without ASCII white space.  A hash is a polynomial in the bytes
    modulo 2**64, taken from one running sum, then finalised with the length.
    """
    joined = b"\n".join(texts)
    buf = _LOWER[np.frombuffer(joined, np.uint8)]
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.diff(np.concatenate((np.ones(1, np.int8), _SPACE[buf].view(np.int8), np.ones(1, np.int8))))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    last = buf[end - 1].astype(np.int64) * 256 + np.where(end - start > 1, buf[np.maximum(end - 2, 0)], 0)
    return np.searchsorted(ends, start, side="right"), h, last
