"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or a temporary one where it is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext.setCheckpointDir(base)
    return base


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Python workers get Arrow batches of `size` bytes at most, if given, in what is run meanwhile."""
    before = spark.conf.get(BATCH_BYTES)
    try:
        if size:
            spark.conf.set(BATCH_BYTES, size)
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


class Scratch:
    """Tables written to the shared folder to cut lineage, so a lost executor costs a reread and not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
        """Write `df` once and read it back from the shared folder. Python workers get batches of `batch_bytes` at most, if given."""
        with batches_of(self.spark, batch_bytes):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def size(self, name: str) -> int:
        """Bytes that a written table takes."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free(self, *names: str) -> None:
        """Delete tables, and let Spark remove the shuffle files of plans that have ended: it does so for plans that the
        driver's garbage collector has found unused, which a small driver seldom runs by itself."""
        self.drop(*names)
        self.spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bit_table(hashes: DataFrame, bits: int) -> bytes:
    """A table of 2**bits bits with the leading bits of each hash (a column `h`) set; its size doesn't depend on the data.

    A task asks it whether a row may have a partner before the row is shuffled; what it lets through wrongly, a join drops.
    """
    slot = F.expr(f"shiftrightunsigned(h, {64 - bits})")
    words = hashes.select((slot / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) % 64 as int))").alias("bit"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("b")).toLocalIterator():  # at most as many rows as the table has words
        table[r.word] = r.b & 0xFFFFFFFFFFFFFFFF
    return table.tobytes()


def in_table(table: bytes, bits: int, h: np.ndarray) -> np.ndarray:
    """Which of an array of 64-bit hashes the table may hold."""
    words, slot = np.frombuffer(table, np.uint64), h.astype(np.uint64, copy=False) >> np.uint64(64 - bits)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def word_count(text):
    """Number of words of a text column, words being runs other than ASCII white space; 0 for null or blank."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")
