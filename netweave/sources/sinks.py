"""The document store: union of stages, clean-up of fields, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.operators.quality import parsed


def union_topics(*topics: DataFrame) -> DataFrame:
    first, *rest = topics
    for topic in rest:
        first = first.unionByName(topic, allowMissingColumns=True)
    return first


def latest_per_id(documents: DataFrame) -> DataFrame:
    """Newest document of each ``_id``; on equal times the later stage wins.

    A maximum per id is combined before the shuffle, so an id with very many copies
    moves one row per task.
    """
    payload = F.struct(*[c for c in documents.columns if c != "_id"])
    newest = F.max_by(payload, F.struct("timestamp", "stage_rank"))
    return documents.groupBy("_id").agg(newest.alias("d")).select("_id", "d.*")


def collection(topics: list[DataFrame], mode: str = "upsert") -> DataFrame:
    """One store for all stages: one document per ``_id``, or every message as it came."""
    documents = union_topics(*topics)
    return latest_per_id(documents) if mode == "upsert" else documents


def sink_fields(messages: DataFrame) -> DataFrame:
    """The log's record time becomes the timestamp; a missing training flag is false."""
    return messages.withColumn("timestamp", F.col("record_ts")).withColumn(
        "is_training", F.coalesce(F.col("is_training"), F.lit(False))
    )


def tolerant(messages: DataFrame) -> DataFrame:
    """Parse each message; broken ones stay in the output with ``accepted`` false."""
    return parsed(messages).withColumn(
        "accepted", F.col("keys").isNotNull() & F.col("doc._corrupt_record").isNull()
    )


def within_retention(messages: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    return messages.filter(F.col("record_ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def write_collection(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Day folders whose files hold one stretch of time each, so a time range reads little.

    Rows are dealt by ranges of (day, time), cut by the sizes that are there: a busy day is spread
    over as many writers as its share of the rows asks for.
    """
    (
        documents.withColumn("day", F.to_date("timestamp"))
        .repartitionByRange("day", "timestamp", "_id")
        .sortWithinPartitions("day", "timestamp")
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


def read_collection(spark, path: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Stored documents in a time range; the day bounds prune folders."""
    documents = spark.read.parquet(path)
    if start is not None:
        documents = documents.filter((F.col("day") >= F.to_date(start)) & (F.col("timestamp") >= start))
    if end is not None:
        documents = documents.filter((F.col("day") <= F.to_date(end)) & (F.col("timestamp") <= end))
    return documents.drop("day")


def export_training_set(sequences: DataFrame, path: str) -> None:
    """Scaled training sequences as a file set for later fits."""
    (
        sequences.filter(F.col("is_training"))
        .select("_id", "sensor_id", "epoch", "seq_no", "sequence")
        .write.mode("errorifexists")
        .parquet(path)
    )
