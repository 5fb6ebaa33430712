"""Helpers shared by the corpus operators: the shared scratch folder, cut lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch on its way to Python.
BATCH = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is unset (tests in local mode) a temporary folder is set; on a
    cluster an unset folder is an error, since a machine-local one would not survive.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tapestride-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Written tables under the shared folder; each cuts the lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads a table. While it is written, Arrow batches hold 8 MB, not 64: they lie in
        buffers outside the JVM's heap and once more in Python, in each running task."""
        conf, key = self.spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        before = conf.get(key)
        conf.set(key, str(BATCH))
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run):
    """The function of a ``mapInArrow``, which gives free memory back when a task ends: Python
    workers are used again by stages that need it otherwise."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return task


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose column ``text`` holds about ``limit`` bytes at most, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
            if held and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores added until no column of ``df`` has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bits_for(n: int) -> int:
    """Bits of a bitmap of n values: 16 for each up to 8 million, so that 6 % of others pass; 2 ** 27 (16 MB)
    at most, with which more and more others pass. What passes is always joined exactly afterwards."""
    return min(1 << 27, max(1 << 20, 1 << (16 * n - 1).bit_length())) if n else 1 << 20


def bitmap(ids: DataFrame, name: str, bits: int) -> np.ndarray:
    """A number of bits, packed, with those of a long column's values set; a task sends them merged."""
    place = F.pmod(F.col(name), F.lit(bits)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("own")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.own), np.uint8)
    return out


def has_bits(packed: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    """Which ids have their bit set in a bitmap."""
    at = ids % bits
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
