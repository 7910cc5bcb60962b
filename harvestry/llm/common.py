"""What the operators of this subpackage share: reading, shared scratch space, partition counts, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import math
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in the pattern language of Java; words of bytes are what bytes.split() gives.
WORD = r"[^ \x09-\x0D]+"
MASK = (1 << 64) - 1
_OWN: list[str] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one where that is unset and
    they are one process. On a cluster the setting is required: other executors would not see a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="harvestry-"))
        root = _OWN[0]
    return f"{root.rstrip('/')}/harvestry-{uuid.uuid4().hex}"


@contextlib.contextmanager
def leaving_no_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed within go when it is done: a table that was written needs them no more."""
    had = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if had is None else spark.conf.set(_CLEAN, had)


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """df from a Parquet table in the shared folder: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = at or shared_dir(spark)
    with leaving_no_shuffles(spark):
        df.write.parquet(path)
    atexit.register(forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def numbered(df: DataFrame) -> tuple[DataFrame, F.Column]:
    """df, and a column that names each of its rows the same at each reading: a file's rows by a hash of its path and their
    places; other tables are written first."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        df.select(place)
        return df, place
    except AnalysisException:  # not the rows of Parquet files
        df = written(df)
        return df, place


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table of written(); quietly does nothing once the session has ended."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone
        return


def parts(df: DataFrame, per_mb: float = 12.0, enough: int | None = None) -> int:
    """Partitions for df's rows: one for each per_mb of the plan's estimated input, spark.sql.shuffle.partitions at least, or
    enough where that is less and the input is known."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size >= 1 << 60:
        return least
    return max(least if enough is None else min(least, enough), min(200_000, math.ceil(size / (per_mb * 1e6))))


def lean(run):
    """A function of Arrow batches that gives its memory back when it ends, for workers outlive their tasks and share an
    executor with the next ones."""

    @functools.wraps(run)
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return done


def size_of_words(text) -> F.Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                p = np.full(m, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def rolled(values: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every run of width values, from one prefix sum."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.to(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[width:] - total[:n]) * down[:n]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OF_BYTES = Powers(0x5851F42D4C957F2D)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word in bytes."""
    edge = np.ones(len(buf) + 2, np.int8)
    edge[1:-1] = _SPACE[buf]
    at = np.flatnonzero(np.diff(edge))
    return at[::2], at[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """A 64-bit hash of each word's bytes; memory is bounded by step and the longest word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + step, "right")))
        piece = buf[lo : int(ends[j - 1])]
        up, down = _OF_BYTES.to(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * up[: len(piece)], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def planes(x: np.ndarray) -> bytes:
    """Integers as bytes by significance, so that small numbers compress well."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()
