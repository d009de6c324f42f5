"""Packet rows to feature rows, and the packet filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.functions.features import (
    TCP,
    UDP,
    feature_columns,
    has_all_fields,
    human_fields,
)
from netweave.functions.search import constant_array, count_not_above
from netweave.plans.ordering import ROWS_PER_SPLIT, Total, running
from netweave.schemas import FEATURE_COUNT, FEATURES

# TCP SYN+ACK bits, smallest legal IP header length in words.
SYN_ACK = 0x12
MIN_IHL = 5
MAX_LITERAL_WINDOWS = 10_000


def only_ip(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("proto").isNotNull())


def featurize(packets: DataFrame) -> DataFrame:
    """Features and readable record of every usable packet; the others are dropped."""
    human = F.struct(*[c.alias(n) for n, c in human_fields().items()])
    return (
        packets.filter(has_all_fields())
        .withColumns(feature_columns())
        .withColumn("human_readable", human)
    )


def feature_vector() -> Column:
    return F.array(*[F.col(f) for f in FEATURES])


def well_sized(vectors: DataFrame, column: str = "features", strict: bool = False) -> DataFrame:
    """Keep vectors of the expected width; ``strict`` raises on any other instead."""
    right_size = F.coalesce(F.size(column) == FEATURE_COUNT, F.lit(False))
    if strict:
        message = F.lit(f"packet must have {FEATURE_COUNT} features")
        checked = F.when(right_size, F.col(column)).otherwise(F.raise_error(message))
        return vectors.withColumn(column, checked)
    return vectors.filter(right_size)


def safe_number(value: Column) -> Column:
    """Text as a whole number, else as a fraction, else zero."""
    return F.coalesce(value.try_cast("bigint").cast("double"), value.try_cast("double"), F.lit(0.0))


def watched_ports(packets: DataFrame, host: str, ports: list[int]) -> DataFrame:
    """TCP or UDP packets sent to ``host`` on one of ``ports``."""
    return packets.filter(
        F.col("proto").isin(TCP, UDP) & F.col("dst_port").isin(ports) & (F.col("dst_ip") == host)
    )


def syn_ack_replies(packets: DataFrame) -> DataFrame:
    return packets.filter((F.col("proto") == TCP) & (F.col("tcp_flags") == SYN_ACK))


def malformed_headers(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("ihl") < MIN_IHL)


#: Keys that the packets of one group and day are dealt over in a stream.
GROUP_SALTS = 8


def in_training_window(ts: Column, start: Column, end: Column, requested_at: Column) -> Column:
    """A window that starts in the past counts from the moment it was requested."""
    return F.coalesce((ts >= F.greatest(start, requested_at)) & (ts <= end), F.lit(False))


def label_training(
    packets: DataFrame,
    windows: DataFrame,
    group: list[str] | None = None,
    literal_windows: int | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Mark packets that fall into any row (start, end) of ``windows``.

    A packet is covered when the latest end among the windows that started no later
    than the packet is not before it. A short window list, checked by count, becomes
    a searched literal without any shuffle. A longer one is merged into the ordered
    packets and its running maximum of ends is compared with the packet's time.
    """
    group = list(group or [])
    literal_windows = MAX_LITERAL_WINDOWS if literal_windows is None else literal_windows
    starts = F.unix_micros(F.col("start").cast("timestamp"))
    ends = F.unix_micros(F.col("end").cast("timestamp"))
    if "requested_at" in windows.columns:
        starts = F.when(starts.isNotNull(), F.greatest(starts, F.unix_micros(F.col("requested_at").cast("timestamp"))))
    # a window without a start or an end, or whose end is before its start, covers nothing
    spans = windows.select(*group, starts.alias("_start"), ends.alias("_end")).filter("_start <= _end")
    now = F.unix_micros(F.col("ts").cast("timestamp"))
    if packets.isStreaming:
        return _label_stream(packets, spans, group, now)
    few = [] if group else spans.select("_start", "_end").limit(literal_windows + 1).collect()
    if not group and len(few) <= literal_windows:
        return _label_from_literal(packets, few, now)
    marks = spans.select(
        *group,
        F.col("_start").alias("_us"),
        F.lit(0).alias("_kind"),
        F.col("_end").alias("_until"),
        F.xxhash64("_start", "_end").alias("_tie"),
        F.lit(None).cast(packets.select(F.struct("*").alias("p")).schema["p"].dataType).alias("_packet"),
    ).distinct()
    rows = packets.select(
        *group,
        now.alias("_us"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast("long").alias("_until"),
        F.col("packet_id").alias("_tie"),
        F.struct(*packets.columns).alias("_packet"),
    )
    covered = running(
        marks.unionByName(rows),
        ["_us", "_kind", "_tie"],
        {"_latest_end": Total("max", F.col("_until"))},
        group,
        rows_per_split=rows_per_split,
    )
    flag = F.coalesce(F.col("_latest_end") >= F.col("_us"), F.lit(False)).alias("is_training")
    return covered.filter(F.col("_kind") == 1).select("_packet.*", flag)


def _label_stream(packets: DataFrame, spans: DataFrame, group: list[str], now: Column) -> DataFrame:
    """Stream rows against windows of any number: disjoint intervals, joined by group and day, so that a row meets one at most.

    Packets of one day, and of one busy sensor, are dealt over several keys, as streams have no skew handling; the windows
    are repeated for each. They are a static side, as known to the files that were listed when the query was built;
    ``streaming.windows`` has the labeller that lists them anew in every micro-batch.
    """
    day = 86_400_000_000
    salts = GROUP_SALTS if group else int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = Window.partitionBy(*group).orderBy("_start", "_end")
    reach = F.max("_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        spans.withColumn("_new", F.when(F.col("_start") <= reach, 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*group, "_island").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"))
        .withColumn("_day", F.explode(F.sequence(F.floor(F.col("_start") / day), F.floor(F.col("_end") / day))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    merged = merged.select(*[F.col(g).alias(f"_window_{g}") for g in group], "_start", "_end", "_day", "_salt")
    salt = F.pmod(F.xxhash64("packet_id"), F.lit(salts)).cast("int")
    match = (F.floor(now / day) == F.col("_day")) & (salt == F.col("_salt")) & (now >= F.col("_start")) & (now <= F.col("_end"))
    for g in group:
        match = match & packets[g].eqNullSafe(F.col(f"_window_{g}"))
    return packets.join(merged, match, "left").select(*packets.columns, F.col("_start").isNotNull().alias("is_training"))


def _label_from_literal(packets: DataFrame, spans: list, now: Column) -> DataFrame:
    ordered = sorted((row["_start"], row["_end"]) for row in spans if None not in tuple(row))
    starts, latest = [], []
    for start, end in ordered:
        starts.append(start)
        latest.append(max(end, latest[-1]) if latest else end)
    if not starts:
        return packets.withColumn("is_training", F.lit(False))
    begun = count_not_above(constant_array(starts, T.LongType()), len(starts), now)
    until = F.get(constant_array(latest, T.LongType()), begun - 1)
    return packets.withColumn("is_training", F.coalesce(until >= now, F.lit(False)))
