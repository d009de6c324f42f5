"""Small driver-side operations on files of any store that Spark can reach."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    """The file system that ``path`` is in, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    store, place = _store(spark, path)
    store.delete(place, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    store, place = _store(spark, folder)
    return [entry.getPath().getName() for entry in store.listStatus(place)] if store.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _store(spark, path)
    source = store.open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def _write(spark: SparkSession, path: str, text: str) -> str:
    """The text in a file of its own beside ``path``."""
    head, _, name = path.rpartition("/")
    own = f"{head}/.{name}-{uuid.uuid4().hex}"
    store, place = _store(spark, own)
    out = store.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return own


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write or replace a small file; readers see the old or the new one."""
    own = _write(spark, path, text)
    store, place = _store(spark, path)
    store.delete(place, False)
    if not store.rename(_store(spark, own)[1], place):
        raise OSError(f"cannot write {path}")


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file only if there is none of that name: of several writers one succeeds."""
    own = _write(spark, path, text)
    store, place = _store(spark, path)
    if store.getScheme() == "file":
        try:
            os.link(_local(own), _local(path))  # fails where the name is taken, unlike a local rename
            return True
        except FileExistsError:
            return False
        finally:
            delete(spark, own)
    if store.exists(place) or not store.rename(_store(spark, own)[1], place):
        delete(spark, own)
        return False
    return True


def _local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path
