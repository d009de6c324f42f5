"""Topics: keyed JSON records in a folder (or Kafka), read whole or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.schemas import PACKET, TOPIC

# Times keep their microseconds; UTC is marked by Z.
TIME_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def to_topic(messages: DataFrame, record_ts: Column | None = None) -> DataFrame:
    """One keyed JSON record per message; null fields are written."""
    columns = [
        F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name)
        for f in messages.schema.fields
    ]
    value = F.to_json(F.struct(*columns), {"ignoreNullFields": "false", **TIME_FORMAT})
    stamp = record_ts if record_ts is not None else F.col("timestamp").cast("timestamp")
    return messages.select(F.col("_id").alias("key"), value.alias("value"), stamp.alias("record_ts"))


def route(valid: DataFrame) -> DataFrame:
    """One row per message and target ``topic``: all are processed, training ones also train.

    The messages are read once for both targets.
    """
    targets = F.when(F.col("is_training"), F.array(F.lit("processed"), F.lit("training"))).otherwise(
        F.array(F.lit("processed"))
    )
    return valid.withColumn("topic", F.explode(targets))


def write_topic(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """All records of a topic from its beginning."""
    return spark.read.schema(TOPIC).parquet(path)


def stream_topic(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New records of a topic; each query's checkpoint is its own reading position."""
    reader = spark.readStream.schema(TOPIC)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_packets(spark: SparkSession, path: str, files_per_batch: int | None = None, kind: str = "parquet") -> DataFrame:
    """Packet records as they arrive in a folder."""
    reader = spark.readStream.schema(PACKET).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, from_start: bool = True) -> DataFrame:
    """The same records from Kafka. Needs the Kafka package on the cluster; untested here."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest" if from_start else "latest")
        .load()
        .select(
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            F.col("timestamp").alias("record_ts"),
        )
    )
