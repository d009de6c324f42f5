"""Order-dependent computations that do not put a whole group into one task.

A window over ``PARTITION BY sensor ORDER BY ts`` sorts all packets of a sensor in
one task. Everything here first cuts the ordered table at explicit split points
taken from a sample, so the pieces are about equal in size whatever the keys look
like (a sensor, an instant or a value may hold most rows). Each piece is reduced
to a partial total, the partial totals are summed in order (at most one row per
piece and group), and the remaining work is a window inside one piece. The
results are exact: the sample only chooses where to cut. Null groups are groups like
others, null keys come first (last where descending), and NaN after every number.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.functions.search import constant_array, count_not_above

ROWS_PER_SPLIT = 2_000_000
MAX_SPLITS = 32_768
SAMPLE_PER_SPLIT = 200
#: Names of the columns that piece and group stand in meanwhile; no table has them.
SPLIT, GROUP = (f"{name}_{uuid.uuid4().hex}" for name in ("split", "group"))


@dataclass(frozen=True)
class Total:
    """A running total: ``kind`` is sum, min or max of ``value``."""

    kind: str
    value: Column

    def aggregate(self, value: Column | None = None) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.value if value is None else value)

    def combine(self, before: Column, here: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(before + here, before, here)
        return (F.least if self.kind == "min" else F.greatest)(before, here)


def _key_column(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int")
    return F.col(name)


@dataclass(frozen=True)
class Splits:
    """Cut points over the ordering key; ``count`` points make ``count + 1`` pieces."""

    points: Column | None
    count: int
    key: Column

    def piece(self) -> Column:
        return count_not_above(self.points, self.count, self.key)


def find_splits(
    df: DataFrame,
    order: list[str],
    rows_per_split: int = ROWS_PER_SPLIT,
    max_splits: int = MAX_SPLITS,
) -> Splits:
    key = F.struct(*[_key_column(df, c).alias(c) for c in order])
    total = df.count()
    pieces = min(max_splits, math.ceil(total / rows_per_split))
    if pieces < 2:
        return Splits(None, 0, key)
    fraction = min(1.0, pieces * SAMPLE_PER_SPLIT / total)
    keys = df.select(key.alias("key"))
    if fraction < 1.0:
        keys = keys.sample(fraction=fraction, seed=17)
    # the sample is sorted in a few tasks, however many pieces there are; each gives every so many-th of its keys
    tasks = min(pieces, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = max(1, math.ceil(total * fraction / pieces))
    cuts = (
        keys.select("key.*")
        .repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .select(F.struct(*order).alias("key"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
        .filter(F.col("place") % every == 0)
        .select("key")
        .distinct()
    )
    # Spark sorts the cuts, so that nulls and NaN stand where its windows put them
    found = [tuple(row["key"]) for row in cuts.orderBy("key").collect()][1:]
    element = cuts.schema["key"].dataType
    points = [dict(zip(order, values)) for values in found]
    return Splits(constant_array(points, element), len(points), key)


def _local_order(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def _cut(df: DataFrame, splits: Splits, group: list[str]) -> DataFrame:
    """Rows with their piece and their group as one value that is never null, so that joins match null groups."""
    return df.withColumns({SPLIT: splits.piece(), GROUP: F.struct(*[F.col(g) for g in group]) if group else F.struct(F.lit(0))})


def _with_before(pieces: DataFrame, totals: dict[str, Total], descending: bool) -> DataFrame:
    """Per piece: the totals of everything that comes earlier in the order."""
    partial = pieces.groupBy(GROUP, SPLIT).agg(*[t.aggregate().alias(n) for n, t in totals.items()])
    frame = Window.partitionBy(GROUP).orderBy(SPLIT)
    if descending:
        frame = frame.rowsBetween(1, Window.unboundedFollowing)
    else:
        frame = frame.rowsBetween(Window.unboundedPreceding, -1)
    return partial.select(
        GROUP,
        SPLIT,
        *[t.aggregate(F.col(n)).over(frame).alias(f"_before_{n}") for n, t in totals.items()],
    )


def running(
    df: DataFrame,
    order: list[str],
    totals: dict[str, Total],
    group: list[str] | None = None,
    descending: bool = False,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Add inclusive running totals per ``group`` along ``order`` (a unique order)."""
    group = list(group or [])
    splits = find_splits(df, [*group, *order], rows_per_split)
    by = _local_order(order, descending)
    if splits.count == 0:
        frame = Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[t.aggregate().over(frame).alias(n) for n, t in totals.items()])
    pieces = _cut(df, splits, group)
    before = _with_before(pieces, totals, descending)
    frame = (
        Window.partitionBy(GROUP, SPLIT).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        pieces.join(before, [GROUP, SPLIT])
        .select(
            *df.columns,
            *[
                t.combine(F.col(f"_before_{n}"), t.aggregate().over(frame)).alias(n)
                for n, t in totals.items()
            ],
        )
    )


def ordinals(
    df: DataFrame,
    order: list[str],
    name: str = "ordinal",
    group: list[str] | None = None,
    descending: bool = False,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Add the 1-based position of each row per ``group`` along ``order``."""
    one = Total("sum", F.lit(1).cast("long"))
    return running(df, order, {name: one}, group, descending, rows_per_split)


def first_rows(
    df: DataFrame,
    order: list[str],
    n: int,
    group: list[str],
    descending: bool = False,
    name: str = "rank",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """The first ``n`` rows of each group along ``order``, with their rank.

    Pieces that start beyond rank ``n`` are dropped before anything is sorted.
    """
    splits = find_splits(df, [*group, *order], rows_per_split)
    by = _local_order(order, descending)
    if splits.count == 0:
        frame = Window.partitionBy(*group).orderBy(*by)
        return df.withColumn(name, F.row_number().over(frame)).filter(F.col(name) <= n)
    pieces = _cut(df, splits, group)
    one = Total("sum", F.lit(1).cast("long"))
    before = _with_before(pieces, {name: one}, descending)
    before = before.withColumn("_before", F.coalesce(F.col(f"_before_{name}"), F.lit(0)))
    frame = Window.partitionBy(GROUP, SPLIT).orderBy(*by)
    return (
        pieces.join(before.filter(F.col("_before") < n), [GROUP, SPLIT])
        .select(*df.columns, (F.col("_before") + F.row_number().over(frame)).cast("int").alias(name))
        .filter(F.col(name) <= n)
    )


def row_at(
    df: DataFrame,
    order: list[str],
    position: Column,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """The single row at a 0-based position of the whole ordered table.

    ``position`` may use the column ``n``, the row count. Only the piece that holds
    the position is sorted.
    """
    splits = find_splits(df, order, rows_per_split)
    pieces = df.withColumn(SPLIT, splits.piece().cast("int"))
    counts = pieces.groupBy(SPLIT).agg(F.count("*").alias("_rows"))
    along = Window.orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    target = (
        counts.select(
            SPLIT,
            "_rows",
            F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"),
            F.sum("_rows").over(whole).alias("n"),
        )
        .withColumn("_position", position.cast("long"))
        .filter((F.col("_position") >= F.col("_before")) & (F.col("_position") < F.col("_before") + F.col("_rows")))
        .select(SPLIT, "_before", "_position")
    )
    frame = Window.partitionBy(SPLIT).orderBy(*order)
    return (
        pieces.join(F.broadcast(target), SPLIT)
        .withColumn("_rn", F.row_number().over(frame))
        .filter(F.col("_rn") == F.col("_position") - F.col("_before") + 1)
        .select(*df.columns)
    )


def rows_between(
    df: DataFrame,
    order: list[str],
    first: int,
    stop: int,
    name: str = "rank",
    descending: bool = False,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """The rows at the 0-based positions ``first`` up to before ``stop`` of the whole ordered table, with the 1-based one.

    A directory of rows per piece tells which pieces hold these positions; only those are sorted, each in its own task.
    """
    splits = find_splits(df, order, rows_per_split)
    pieces = df.withColumn(SPLIT, splits.piece().cast("int"))
    counts = pieces.groupBy(SPLIT).agg(F.count("*").alias("_rows"))
    along = Window.orderBy(F.desc(SPLIT) if descending else SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    hit = (
        counts.withColumn("_before", F.coalesce(F.sum("_rows").over(along), F.lit(0)))
        .filter((F.col("_before") < stop) & (F.col("_before") + F.col("_rows") > first))
        .select(SPLIT, "_before")
    )
    frame = Window.partitionBy(SPLIT).orderBy(*_local_order(order, descending))
    return (
        pieces.join(F.broadcast(hit), SPLIT)  # a row per piece of the range at most
        .withColumn("_at", F.col("_before") + F.row_number().over(frame))
        .filter((F.col("_at") > first) & (F.col("_at") <= stop))
        .select(*df.columns, F.col("_at").alias(name))
    )


def sliding(
    df: DataFrame,
    order: list[str],
    length: int,
    item: Column,
    name: str,
    group: list[str] | None = None,
    block: int = 10_000,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Array of the last ``length`` items at each row, full windows only.

    The ordered rows are cut into blocks; the last ``length - 1`` rows of a block are
    copied into the next one, so each block is complete by itself.
    """
    group = list(group or [])
    block = max(block, length)
    placed = ordinals(df, order, "_at", group, rows_per_split=rows_per_split)
    home = F.floor((F.col("_at") - 1) / block).cast("long")
    in_tail = (F.col("_at") - 1) % block >= block - (length - 1)
    spread = placed.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    frame = Window.partitionBy(*group, "_block").orderBy("_at").rowsBetween(-(length - 1), 0)
    return (
        spread.withColumn(name, F.collect_list(item).over(frame))
        .filter((F.col("_home") == F.col("_block")) & (F.col("_at") >= length))
        .select(*df.columns, name)
    )

