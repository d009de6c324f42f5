"""Message streams: routing, scoring, storing, counting, health and detectors.

Each function maps a stream to a stream of rows; the caller starts it with one of
the writers at the end. Progress is in the checkpoint of the started query: the
same checkpoint goes on after a restart, a new one reads everything again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from netweave.functions.features import TCP, UDP
from netweave.functions.losses import sequence_error
from netweave.functions.search import constant_array
from netweave.operators import quality as ql
from netweave.operators import scoring as sc
from netweave.schemas import ANOMALY_THRESHOLD, FEATURE_COUNT, SEQUENCE_LENGTH
from netweave.sources import files, sinks, topics
from netweave.sources.topics import to_topic


def route_messages(raw: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Raw records to the topics processed, training and rejected, in one pass."""
    at = F.current_timestamp() if processed_at is None else processed_at
    log = ql.checked(raw, ql.raw_reason())
    refused = F.col("reason").isNotNull()
    targets = (
        F.when(refused, F.array(F.lit("rejected")))
        .when(F.col("doc.is_training"), F.array(F.lit("processed"), F.lit("training")))
        .otherwise(F.array(F.lit("processed")))
    )
    reset = F.struct(
        F.col("doc._id").alias("_id"),
        at.alias("timestamp"),
        F.col("doc.sequence").alias("sequence"),
        F.col("doc.human_readable").alias("human_readable"),
        F.lit(False).alias("is_anomaly"),
        F.col("doc.is_training").alias("is_training"),
        F.lit(False).alias("is_false_positive"),
        F.lit(None).cast("double").alias("reconstruction_error"),
        F.col("doc.familiarity").alias("familiarity"),
    )
    clean = F.to_json(reset, {"ignoreNullFields": "false", **topics.TIME_FORMAT})
    return log.select(
        F.explode(targets).alias("topic"),
        "key",
        F.when(refused, F.col("value")).otherwise(clean).alias("value"),
        "reason",
        F.when(refused, F.col("record_ts")).otherwise(at).alias("record_ts"),
    )


def score_messages(
    processed: DataFrame,
    reconstruction: list[list[float]],
    threshold: float = ANOMALY_THRESHOLD,
    scored_at: Column | None = None,
) -> DataFrame:
    """Processed records to prediction records with a model that is fixed at the start; an untrained one reconstructs zeros.

    ``streaming.scoring`` has the stage that follows the model store, and gives rejects.
    """
    reconstruction = reconstruction or [[0.0] * FEATURE_COUNT] * SEQUENCE_LENGTH
    log = ql.checked(processed, ql.scoring_reason())
    model = constant_array(reconstruction, T.ArrayType(T.DoubleType()))
    scored = ql.valid_messages(log).withColumn("reconstruction_error", sequence_error(F.col("sequence"), model))
    at = F.current_timestamp() if scored_at is None else scored_at
    return to_topic(sc.to_predictions(scored, at, threshold))


def fixed_model(model: DataFrame) -> list[list[float]]:
    """The rank-0 model as numbers: one 16 x 12 matrix, or nothing if there was nothing to learn from."""
    return [list(row) for row in model.first()["reconstruction"] or []]


def stored_documents(*stages: tuple[str, int, DataFrame]) -> DataFrame:
    """Records of several stages as documents for the store.

    ``timestamp`` is the record time, a missing training flag is false, broken records
    are left out. The newest document of an ``_id`` is taken when the store is read.
    """
    read = [
        sinks.sink_fields(ql.readable_messages(records)).withColumns(
            {"stage": F.lit(name), "stage_rank": F.lit(rank)}
        )
        for name, rank, records in stages
    ]
    return sinks.union_topics(*read).withColumn("day", F.to_date("timestamp"))


def counters(predictions: DataFrame) -> DataFrame:
    """The three prediction counters; write with output mode complete."""
    flagged = ql.readable_messages(predictions)
    return flagged.groupBy().agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_anomaly")).alias("normal"),
        F.count_if(F.col("is_anomaly")).alias("anomalous"),
    )


def last_seen(stage_log: DataFrame) -> DataFrame:
    """Newest event time per stage; write with output mode complete or update."""
    return stage_log.groupBy("stage").agg(F.max("timestamp").alias("timestamp"))


def port_scan_stream(packets: DataFrame, window: str, min_ports: int, delay: str) -> DataFrame:
    """Scans per closed window; a packet later than ``delay`` is not counted."""
    per_port = (
        packets.filter(F.col("proto") == TCP)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "src_ip", "dst_ip", "dst_port")
        .agg(F.count("*").alias("packets"))
    )
    return (
        per_port.groupBy("window", "src_ip", "dst_ip")
        .agg(F.count("*").alias("ports"), F.sum("packets").alias("packets"))
        .filter(F.col("ports") >= min_ports)
        .select(F.col("window.start").alias("window_start"), "src_ip", "dst_ip", "ports", "packets")
    )


def udp_flood_stream(packets: DataFrame, window: str, min_packets: int, delay: str, slide: str | None = None) -> DataFrame:
    """Floods per closed tumbling window, or sliding window when ``slide`` is given."""
    return (
        packets.filter(F.col("proto") == UDP)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide), "dst_ip")
        .agg(F.count("*").alias("packets"), F.sum("udp_len").alias("bytes"))
        .filter(F.col("packets") >= min_packets)
        .select(F.col("window.start").alias("window_start"), "dst_ip", "packets", "bytes")
    )


def start_files(rows: DataFrame, path: str, checkpoint: str, partition: str | None = None, once: bool = True) -> StreamingQuery:
    """Append to files, exactly once. ``once`` handles what is there and stops."""
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if partition:
        writer = writer.partitionBy(partition)
    return _trigger(writer, once).start(path)


def start_batches(rows: DataFrame, handle, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Hand each micro-batch to ``handle(batch, batch_id)``."""
    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode)
    return _trigger(writer, once).start()


def _trigger(writer, once: bool):
    return writer.trigger(availableNow=True) if once else writer


def replace_table(path: str):
    """``foreachBatch`` function for small complete results, such as counters; the last two results are kept, for readers of the older one."""

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        written = [int(n.removeprefix("batch=")) for n in files.names(batch.sparkSession, path) if n.startswith("batch=")]
        for old in sorted(written)[:-2]:
            files.delete(batch.sparkSession, f"{path}/batch={old}")

    return replace


def newest_table(spark, path: str) -> DataFrame:
    """The last result written by ``replace_table``."""
    results = spark.read.parquet(path)
    return results.filter(F.col("batch") == results.agg(F.max("batch")).scalar()).drop("batch")
