"""What several operators share: shared folders, stored steps, words, split files."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: what separates words.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def shared(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for a local session that names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or _own_folder()).rstrip("/")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="shared-")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def release(spark: SparkSession, *steps: DataFrame) -> None:
    """Remove stored steps that nothing reads any more, and let Spark drop shuffle files that no plan refers to.

    Spark's cleaner learns of dead plans from the driver's garbage collection, which seldom runs by itself in short jobs.
    """
    for step in steps:
        path = spark._jvm.org.apache.hadoop.fs.Path(step.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Batches of so many rows between Spark and Python for what runs inside, where rows are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Hand what a worker has freed back to the system, since workers go on to the next step; nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def packed(documents: DataFrame) -> Column:
    """All columns of a row as one struct ``given``, so that no name can meet one of an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in documents.columns]).alias("given")


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def local_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, whether it is a URI or a plain path."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def write_file(uri: str, name: str, parts: list) -> None:
    """Write one file of a task: under a name of its own first, then renamed, so retries and doubles agree."""
    fs, path = local_fs(uri)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(own, f"{path}/{name}")


def mapped_file(uri: str, name: str) -> np.ndarray:
    """The file's bytes: memory-mapped where the folder is mounted, else through an unlinked temporary file."""
    fs, path = local_fs(uri)
    full = f"{path}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        if os.path.getsize(full) == 0:
            return np.zeros(0, np.uint8)
        return np.memmap(full, np.uint8, "r")
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(full) as source:
        while block := source.read(1 << 24):
            copy.write(block)
        copy.flush()
        if copy.tell() == 0:
            return np.zeros(0, np.uint8)
        return np.memmap(copy, np.uint8, "r")


def file_exists(uri: str, name: str) -> bool:
    fs, path = local_fs(uri)
    return fs.get_file_info(f"{path}/{name}").type == pafs.FileType.File
