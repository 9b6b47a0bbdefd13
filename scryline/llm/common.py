"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder. Only a local session, as in tests, may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scryline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The result no longer depends on df's lineage, so a lost executor costs one re-read,
    and values such as monotonically_increasing_id() are fixed once and for all.
    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scryline/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(schema).parquet(path)


#: Bytes of an Arrow batch to or from Python.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless it has a smaller bound: texts may be long, and two workers of an executor hold a batch each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    amount, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(name, "64m").lower()).groups()
    if int(amount) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[unit] > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc32_mod(column: Column | str, divisor: int) -> Column:
    """crc32 of the value as text, modulo divisor."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % divisor


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from df's columns (whose case doesn't count)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def release() -> None:
    """Give a worker's free memory back: it is used again, by other stages, beside others on the machine."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in blocks of about `most` bytes of the column: large batches are cut, small ones put together; a longer text is a block of its own."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        lo = 0
        for i, n in enumerate(sizes):
            if size + n > most and (held or i > lo):
                yield pa.Table.from_batches([*held, batch.slice(lo, i - lo)]).combine_chunks().to_batches()[0]
                held, size, lo = [], 0, i
            size += n
        if lo < len(sizes):
            held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
