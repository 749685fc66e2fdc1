"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The folder is the one that ``spark.checkpoint.dir`` names; only where the
    session has none and runs on one machine (tests, a laptop) a temporary one
    is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``cut``, after which the driver collects its garbage.

    Spark forgets shuffles and broadcasts of steps that are over only then, and
    a heap that grows from step to step is kept by the JVM, however little of
    it is in use. For operators of many steps.
    """
    out = cut(df)
    df.sparkSession._jvm.System.gc()
    return out


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two shuffled sides, neither of which is ever collected by the driver to be broadcast, as adaptive execution would do with small ones: many small ones at once, of tables that grow, fill its memory."""
    return left.join(right.hint("merge"), on, how)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder in use, set first if need be."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("-loomwright"))
    return context._jsc.sc().getCheckpointDir().get()


PIECE = 512  #: rows of a batch that are turned into Python values at once


def release() -> None:
    """Give memory that is free back to the system: workers wait for later tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_pieces(run):
    """``run`` for mapInArrow, on batches of at most PIECE rows."""

    def whole(batches):
        try:
            yield from run(batch.slice(at, PIECE) for batch in batches for at in range(0, len(batch), PIECE))
        finally:
            release()

    return whole


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 values (public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class RollingHash:
    """64-bit hashes of many slices of one array, from a running sum.

    sum(values[j] * R**j) over a slice, times R**-start, does not depend on
    where the slice lies. ``values`` must already be well mixed.
    """

    BASE = 0xD1342543DE82EF95

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = pow(self.BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                for name, base in (("up", self.BASE), ("down", inverse)):
                    p = np.full(n, base, np.uint64)
                    p[0] = 1
                    setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        self._powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values * self.up[:n], dtype=np.uint64, out=total[1:])
            h = (total[ends] - total[starts]) * self.down[starts]
            return splitmix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = splitmix(np.arange(1, 257, dtype=np.uint64))
_ROLLING = RollingHash()


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\x20\x09-\x0D]+`` of several byte strings, and where each string's words begin (one more at the end)."""
    joined = b"\n".join(data) + b"\n"
    a = np.frombuffer(joined, np.uint8)
    blank = _BLANK[a]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero((edge == 1) & (np.arange(len(a)) > 0))
    h = _ROLLING.slices(_BYTES[a], starts, ends)
    for i in np.flatnonzero(ends - starts > 256).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    limits = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
    first = np.searchsorted(starts, np.concatenate(([0], limits)))
    return h, first
