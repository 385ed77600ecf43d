"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import ensure_checkpoint_dir

#: Rows and bytes of one Arrow batch: they bound a task's memory, in the JVM and in Python, also where every text is long.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


class Scratch:
    """Tables of one operator call in the shared checkpoint folder.

    ``keep`` writes a table as Parquet and reads it back, which cuts lineage and survives lost executors;
    ``drop`` removes all tables but those named.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/barloom-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{len(self.paths)}"
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *but: str) -> None:
        for name in [n for n in self.paths if n not in but]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts stays in bounds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns cannot clash with those an operator makes."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0))


def unit_hash(col: Column | str, salt: str) -> Column:
    """Deterministic uniform number in [0, 1) for a value."""
    return F.pmod(F.xxhash64(F.lit(salt), col), F.lit(1 << 40)) / F.lit(float(1 << 40))


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", bound: int = 2_000_000) -> DataFrame:
    """Rows of df whose key is (``left_semi``) or is not (``left_anti``) in ids. Up to ``bound`` ids (8 bytes each) are
    broadcast after counting them, so wide rows are not shuffled; beyond that it is an ordinary join."""
    side = F.broadcast(ids) if ids.count() <= bound else ids
    return df.join(side, key, how).select(df.columns)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``limit`` bytes each; one longer text makes a part of its own."""
    sizes = np.zeros(batch.num_rows, np.int64)
    lengths = pc.binary_length(batch.column(column))
    sizes[:] = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (SplitMix64 constants); wraps around."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
