"""Registry of the checked queries: name, survey rows, Spark function, oracle SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.session import pin_utc, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")

        def pinned(spark: SparkSession, folder: str) -> DataFrame:
            return run(pin_utc(spark), folder)

        ENTRIES[name] = Entry(name, covers, pinned, sql)
        return run

    return register


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a query stores. Only a local session may go without a named shared folder."""
    local = spark.sparkContext.master.startswith("local[") and not spark.conf.get("spark.checkpoint.dir", None)
    return f"{_own_folder() if local else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="steps-")


def r6(value: Column) -> Column:
    """Six digits, and no negative zero."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def s6(text: str) -> str:
    return f"(round(cast({text} as double), 6) + 0.0)"
