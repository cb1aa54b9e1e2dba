"""Shared storage and text helpers for the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_fallback: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary one, in local mode only."""
    for read in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if found := read():
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that driver and executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="weaveline-"))
    return _fallback[0]


def publish(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/weaveline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Session setting that bounds the bytes of a batch which goes to Python; without it a batch has 10,000 rows, however long.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bound the batches that this session sends to Python, unless it has a bound of its own."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, most)


#: Cached functions that keep what they made in a worker from task to task.
_kept: list[Callable] = []


def kept_in_worker(cached: Callable) -> Callable:
    """cached, a function under lru_cache, whose cache is emptied when a trimmed function starts in the same worker."""
    _kept.append(cached)
    return cached


def give_back() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def drop_kept() -> None:
    """Empty the caches of kept_in_worker in this process."""
    if any(f.cache_info().currsize for f in _kept):
        for f in _kept:
            f.cache_clear()
        gc.collect()
        give_back()


def trimmed(run: Callable) -> Callable:
    """run, a mapInArrow function, which at its start drops what other operators keep in the worker, and at its end gives freed memory back to the system.

    Workers are kept for later tasks and stages; without this each holds on to the peak of all it has run.
    """

    def each(batches):
        drop_kept()
        try:
            yield from run(batches)
        finally:
            give_back()

    return each


def by_bytes(batch: pa.RecordBatch, column: int, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold most_bytes of one column, or one row where that alone is larger."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + most_rows, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for explicit repartitioning; follows the session so that a cluster sets it once."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
