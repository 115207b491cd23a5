"""What several operators share: tables, shared scratch space, bounded Arrow slices, hashing."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in most contracts: space and the control characters 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Characters of text that one slice of a batch holds (one document at least).
SLICE_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, by Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what an Arrow batch holds, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where it is unset,
    as in local tests) a temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="trawl-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def _folder(df: DataFrame, path: str) -> tuple[Any, Any]:
    """The store that holds a path, and the path, as Hadoop has them."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back. The files outlive lost
    executors; they go with discard(), or when the driver ends."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, at = _folder(df, path)
    store.deleteOnExit(at)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.settled_at = path
    return made


def discard(*settled: DataFrame) -> None:
    """Deletes the files of settled tables that nothing will read again."""
    for df in settled:
        store, at = _folder(df, df.settled_at)
        store.delete(at, True)


#: A key of more rows than this, and than total / HOT_KEYS, is hot; so no more than HOT_KEYS are.
HOT_ROWS, HOT_KEYS = 256, 20_000


def spread_join(rows: DataFrame, stats: DataFrame, key: str, size: str, total: int, by: str) -> DataFrame:
    """rows with the other columns of stats (one row for each key; `size` says how many of `rows` have it, `total` how
    many rows there are at least). The stats of hot keys, HOT_KEYS at most, are sent to the rows, and these are dealt
    by the column `by` too, as are rows without a key; the rest meet by a shuffle. So no task gets all rows of a hot key."""
    limit = max(HOT_ROWS, total // HOT_KEYS)
    others = [c for c in stats.columns if c != key]
    hot = stats.where(F.col(size) > limit).select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in others))
    # always 0, but not a constant, which the optimiser would take out of the keys of the join
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    cold = stats.where(F.col(size) <= limit).select(F.col(key).alias("_cold"), *(F.col(c).alias(f"_cold_{c}") for c in others), zero.alias("_zero"))
    held = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), zero).otherwise(F.xxhash64(by)))
    held = held.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_zero")), "left")
    return held.select(*rows.columns, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in others))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(from row, to row, texts) over a batch, each with about `most` bytes of text; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i, ["" if x is None else x for x in col.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield start, batch.num_rows, ["" if x is None else x for x in col.slice(start).to_pylist()]


def learnable(doc_id: str | Column = "doc_id") -> Column:
    """Rows from which models may learn: crc32 of the id as text, modulo 4, isn't 2 (a null id counts as text '')."""
    held = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(held.cast("string"), F.lit(""))) % 4 != 2


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix), over arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def free_memory() -> None:
    """Gives back what the allocators of this process hold without use. Python workers are kept for later tasks;
    without this each would keep the most that any task needed."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that frees memory when its task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free_memory()

    return tidied


class Memo:
    """A dictionary of bounded size: what wasn't asked for lately goes, a generation at a time."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def fill(self, keys: Collection[str], make: Any) -> dict:
        """A dictionary that has all of `keys`; make(list of unseen keys) gives their values."""
        young, old = self.young, self.old
        missing = []
        for k in keys:
            if k not in young:
                v = old.get(k)
                if v is None:
                    missing.append(k)
                else:
                    young[k] = v
        if missing:
            young.update(zip(missing, make(missing), strict=True))
        if len(young) > self.most:
            self.old, self.young = young, {}
        return young
