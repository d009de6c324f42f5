"""Streams give the same rows as the batch operators, however the input is split."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import views
from netweave.operators import detectors, featurize, quality as ql, scoring as sc, sequencing as sq, serving as sv
from netweave.schemas import PACKET
from netweave.sources import sinks, topics
from netweave.sources.tables import packets, raw_messages
from netweave.streaming import flows
from netweave.streaming.sequencer import MicroBatchSequencer

RULE = sq.SequenceRule(reset_every=100)


@pytest.fixture(scope="module")
def table(spark, small):
    return packets(spark, small).withColumn("ts", F.col("ts").cast("timestamp")).cache()


def split_files(table, folder, parts):
    """Files in time order, one after the other."""
    total = table.count()
    bounds = [round(total * i / parts) for i in range(parts + 1)]
    for low, high in zip(bounds, bounds[1:]):
        piece = table.filter((F.col("packet_id") >= low) & (F.col("packet_id") < high))
        piece.select(*PACKET.fieldNames()).coalesce(1).write.mode("append").parquet(folder)


def labelled(stream):
    return stream.withColumn("is_training", F.col("ts") < F.lit(views.TRAINING_BEFORE).cast("timestamp"))


def keyed(rows):
    return {(r["sensor_id"], r["epoch"], r["seq_no"]): r for r in rows}


@pytest.mark.parametrize("parts, rows_per_split", [(1, 10**6), (3, 50), (10, 10**6)])
def test_sequencer_equals_batch(spark, table, tmp_path, parts, rows_per_split):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    split_files(table, source, parts)
    stream = labelled(topics.stream_packets(spark, source, files_per_batch=1))
    rule = sq.SequenceRule(reset_every=100, rows_per_split=rows_per_split)
    handler = MicroBatchSequencer(out, str(tmp_path / "state"), rule)
    flows.start_batches(stream, handler, str(tmp_path / "check")).awaitTermination()
    wanted = keyed(sq.build_sequences(labelled(table), RULE).collect())
    rows = spark.read.parquet(out).collect()
    got = keyed(rows)
    assert len(rows) == len(got) and got.keys() == wanted.keys() and len(got) > 20
    for key, row in got.items():
        for name in ("seen", "trained", "is_training"):
            assert row[name] == wanted[key][name], (key, name)
        assert row["familiarity"] == pytest.approx(wanted[key]["familiarity"])
        np.testing.assert_allclose(np.array(row["sequence"]), np.array(wanted[key]["sequence"]), atol=1e-6)


def test_repeated_batch_overwrites_itself(spark, table, tmp_path):
    handler = MicroBatchSequencer(str(tmp_path / "out"), str(tmp_path / "state"), RULE)
    first = labelled(table.filter("packet_id < 300"))
    handler(first, 0)
    handler(first, 0)
    handler(labelled(table.filter("packet_id >= 300")), 1)
    handler(labelled(table.filter("packet_id >= 300")), 1)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == sq.build_sequences(labelled(table), RULE).count()


@pytest.fixture(scope="module")
def raw_topic(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("topics") / "raw")
    log = raw_messages(spark, small)
    rows = log.select(F.col("msg_key").alias("key"), "value", F.col("record_ts").cast("timestamp").alias("record_ts"))
    rows.repartition(3).write.parquet(folder)
    return folder


@pytest.fixture(scope="module")
def routed(spark, raw_topic, tmp_path_factory):
    base = tmp_path_factory.mktemp("routed")
    stream = flows.route_messages(topics.stream_topic(spark, raw_topic, 1))
    flows.start_files(stream, str(base / "out"), str(base / "check"), "topic").awaitTermination()
    return str(base / "out")


def test_routing_equals_batch(spark, small, raw_topic, routed):
    log = ql.checked(topics.read_topic(spark, raw_topic), ql.raw_reason())
    valid = ql.valid_messages(log)
    got = {(r["topic"]): r["count"] for r in spark.read.parquet(routed).groupBy("topic").count().collect()}
    assert got == {
        "processed": valid.count(),
        "training": valid.filter("is_training").count(),
        "rejected": ql.rejected_messages(log, "raw").count(),
    }
    sample = json.loads(spark.read.parquet(routed).filter("topic = 'processed'").first()["value"])
    assert sample["reconstruction_error"] is None and sample["is_anomaly"] is False and len(sample["sequence"]) == 16


def processed_stream(spark, routed):
    schema = spark.read.parquet(routed).schema
    return spark.readStream.schema(schema).parquet(routed).filter("topic = 'processed'").select("key", "value", "record_ts")


def test_scoring_and_counters_equal_batch(spark, routed, tmp_path):
    model = [[0.0] * 12 for _ in range(16)]
    model[0][0] = 20.0
    scored = flows.score_messages(processed_stream(spark, routed), model, threshold=0.1)
    out = str(tmp_path / "predictions")
    flows.start_files(scored, out, str(tmp_path / "check")).awaitTermination()
    processed = spark.read.parquet(routed).filter("topic = 'processed'").select("key", "value", "record_ts")
    wanted = flows.score_messages(processed, model, threshold=0.1)
    rows = ql.readable_messages(topics.read_topic(spark, out))
    assert rows.count() == wanted.count() > 0
    error = (191 * 0.005 + 19.4) / 192
    first = rows.first()
    assert first["reconstruction_error"] == pytest.approx(error) and first["is_anomaly"] is True
    counts = str(tmp_path / "counts")
    stream = flows.counters(topics.stream_topic(spark, out, 1))
    flows.start_batches(stream, flows.replace_table(counts), str(tmp_path / "check2"), "complete").awaitTermination()
    got = flows.newest_table(spark, counts).first().asDict()
    assert got == sv.prediction_counts(rows).first().asDict()


def test_restart_goes_on_and_new_checkpoint_reads_all(spark, raw_topic, tmp_path):
    more = str(tmp_path / "in")
    log = topics.read_topic(spark, raw_topic)
    log.filter("key < 'm5'").write.parquet(more)

    def run(name):
        stream = topics.stream_topic(spark, more).select("key")
        flows.start_files(stream, str(tmp_path / name), str(tmp_path / f"check-{name}")).awaitTermination()
        return spark.read.parquet(str(tmp_path / name)).count()

    early = log.filter("key < 'm5'").count()
    assert run("a") == early
    log.filter("key >= 'm5'").write.mode("append").parquet(more)
    assert run("a") == log.count()
    assert run("b") == log.count()


def test_store_stream_keeps_newest_per_id(spark, routed, tmp_path):
    schema = spark.read.parquet(routed).schema
    stages = [
        (name, rank, spark.readStream.schema(schema).parquet(routed).filter(F.col("topic") == name).select("key", "value", "record_ts"))
        for rank, name in ((1, "processed"), (2, "training"))
    ]
    store = str(tmp_path / "store")
    flows.start_files(flows.stored_documents(*stages), store, str(tmp_path / "check"), "day").awaitTermination()
    documents = spark.read.parquet(store)
    assert documents.count() == spark.read.parquet(routed).filter("topic <> 'rejected'").count()
    newest = sinks.latest_per_id(documents)
    assert newest.count() == documents.select("_id").distinct().count()
    assert documents.filter(F.col("is_training").isNull()).count() == 0


def test_freshness_stream(spark, table, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    split_files(table, source, 3)
    stream = topics.stream_packets(spark, source, 1).select(F.col("sensor_id").alias("stage"), F.col("ts").alias("timestamp"))
    flows.start_batches(flows.last_seen(stream), flows.replace_table(out), str(tmp_path / "check"), "complete").awaitTermination()
    got = {r["stage"]: r["timestamp"] for r in flows.newest_table(spark, out).collect()}
    assert got == {r["sensor_id"]: r["t"] for r in table.groupBy("sensor_id").agg(F.max("ts").alias("t")).collect()}
    health = sv.stage_health(flows.newest_table(spark, out), ["s0", "s9"], limit="60 DAYS")
    assert {r["stage"]: r["status"] for r in health.collect()} == {"s0": "healthy", "s9": "not receiving data", "backend": "healthy"}


def test_training_window_on_a_stream(spark, table, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    split_files(table, source, 2)
    windows = spark.sql("select timestamp '2024-01-03' as start, timestamp '2024-01-05' as end")
    stream = featurize.label_training(topics.stream_packets(spark, source, 1), windows)
    flows.start_files(stream, out, str(tmp_path / "check")).awaitTermination()
    wanted = table.filter("ts between timestamp '2024-01-03' and timestamp '2024-01-05'").count()
    assert spark.read.parquet(out).filter("is_training").count() == wanted > 0


@pytest.mark.parametrize("detector", ["scan", "flood", "sliding"])
def test_windowed_detectors_equal_batch_for_closed_windows(spark, table, tmp_path, detector):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    split_files(table, source, 4)
    stream = topics.stream_packets(spark, source, 1)
    if detector == "scan":
        rows = flows.port_scan_stream(stream, "12 hours", 1, "1 hour")
        wanted = detectors.port_scans(table, "12 hours", 1)
    elif detector == "flood":
        rows = flows.udp_flood_stream(stream, "12 hours", 2, "1 hour")
        wanted = detectors.udp_floods(table, "12 hours", 2)
    else:
        rows = flows.udp_flood_stream(stream, "12 hours", 2, "1 hour", "6 hours")
        windowed = table.filter("proto = 17").groupBy(F.window("ts", "12 hours", "6 hours").start.alias("window_start"), "dst_ip")
        wanted = windowed.agg(F.count("*").alias("packets"), F.sum("udp_len").alias("bytes")).filter("packets >= 2")
    flows.start_files(rows, out, str(tmp_path / "check")).awaitTermination()
    closed = table.agg(F.max("ts")).first()[0]
    got = {tuple(r) for r in spark.read.parquet(out).select(*wanted.columns).collect()}
    want = {tuple(r) for r in wanted.filter(F.col("window_start") + F.expr("INTERVAL 14 HOURS") < F.lit(closed)).collect()}
    assert want and want <= got and got <= {tuple(r) for r in wanted.collect()}


def test_scoring_model_from_sequences(spark, table):
    rows = sq.build_sequences(labelled(table), RULE)
    matrix = flows.fixed_model(sc.mean_model(rows))
    assert len(matrix) == 16 and all(len(r) == 12 for r in matrix)
