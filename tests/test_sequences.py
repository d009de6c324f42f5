"""Sequences against a plain replay of the packet buffer, one packet at a time."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.functions.features import feature_columns
from netweave.operators import featurize, sequencing as sq
from netweave.schemas import FEATURES, PACKET

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def packet(i, sensor="a", proto=6, ts=None, **changes):
    row = dict(
        packet_id=i,
        sensor_id=sensor,
        ts=ts or START + timedelta(milliseconds=700 * i),
        src_ip=f"10.0.0.{i % 5}",
        dst_ip=f"192.168.0.{i % 3}",
        ip_len=60 + i % 50,
        ihl=5,
        ip_flags=2,
        ttl=64,
        proto=proto,
        src_port=1024 + i,
        dst_port=443,
        tcp_flags=18,
        tcp_window=500 + i,
        udp_len=None,
        packet_size=80 + i,
    )
    if proto == 17:
        row.update(tcp_flags=None, tcp_window=None, udp_len=30)
    if proto not in (6, 17):
        row.update(src_port=None, dst_port=None, tcp_flags=None, tcp_window=None)
    if proto is None:
        row.update(src_ip=None, dst_ip=None, ip_len=None, ihl=None, ip_flags=None, ttl=None)
    row.update(changes)
    return row


def frame(spark, rows):
    values = [tuple(r[f.name] for f in PACKET.fields) + (bool(r.get("is_training")),) for r in rows]
    from pyspark.sql import types as T

    schema = T.StructType([*PACKET.fields, T.StructField("is_training", T.BooleanType())])
    return spark.createDataFrame(values, schema)


def replay(rows, features, length, reset):
    """Rows in arrival order; features by packet_id, None for an unusable packet."""
    out, buffer, seen, trained, scaler, arrivals, epoch, number = [], [], set(), set(), None, 0, 0, 0
    for row in rows:
        vector = features.get(row["packet_id"])
        if vector is not None:
            buffer.append((row, list(vector)))
            pair = (row["src_ip"], row["dst_ip"])
            seen.add(pair)
            if row.get("is_training"):
                trained.add(pair)
            if len(buffer) == length:
                times = [b[0]["ts"].timestamp() for b in buffer]
                gap = float(np.mean(np.diff(times)))
                matrix = np.array([b[1] for b in buffer])
                matrix[:, 3] = math.log1p(gap) / math.log1p(1) * 2 - 1
                if scaler is None:
                    low, mid, high = np.percentile(matrix, [25, 50, 75], axis=0)
                    spread = np.where(high - low < 1e-12, 1.0, high - low)
                    scaler = (mid, spread)
                known = 0.0 if not trained else 1 - len(seen & trained) / len(seen)
                out.append((epoch, number, (matrix - scaler[0]) / scaler[1], known, bool(row.get("is_training"))))
                buffer, number = [], number + 1
        arrivals += 1
        if arrivals >= reset:
            buffer, seen, trained, scaler, arrivals, epoch, number = [], set(), set(), None, 0, epoch + 1, 0
    return out


def feature_map(df):
    rows = featurize.featurize(df).select("packet_id", *FEATURES).collect()
    return {r["packet_id"]: [r[f] for f in FEATURES] for r in rows}


def mixed(n, sensor="a", seed=1, hot_instant=False):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        proto = rnd.choice([6, 6, 17, 1, 2, 47, None])
        ts = START if hot_instant and i > n // 3 else START + timedelta(milliseconds=rnd.randrange(200, 900) + 1000 * i)
        if hot_instant and i > n // 3:
            ts = START + timedelta(days=1)
        row = packet(i, sensor, proto, ts, is_training=i < n // 2)
        if proto is not None:
            row.update(src_ip=f"10.0.0.{rnd.randrange(12)}", dst_ip=f"10.1.0.{rnd.randrange(5)}")
        rows.append(row)
    return rows


@pytest.mark.parametrize("count", [15, 16, 17, 33])
def test_incomplete_tail_is_dropped(spark, count):
    found = sq.build_sequences(frame(spark, [packet(i) for i in range(count)]))
    assert found.count() == count // 16


@pytest.mark.parametrize("rows_per_split, hot", [(10**6, False), (60, False), (60, True)])
def test_equals_replay(spark, rows_per_split, hot):
    rows = mixed(700, hot_instant=hot)
    df = frame(spark, rows).repartition(5)
    rule = sq.SequenceRule(length=16, reset_every=150, rows_per_split=rows_per_split)
    wanted = replay(rows, feature_map(df), 16, 150)
    found = sq.build_sequences(df, rule).orderBy("epoch", "seq_no").collect()
    assert len(found) == len(wanted) > 20
    for got, (epoch, number, matrix, known, training) in zip(found, wanted):
        assert (got["epoch"], got["seq_no"], got["is_training"]) == (epoch, number, training)
        assert got["familiarity"] == pytest.approx(known)
        np.testing.assert_allclose(np.array(got["sequence"]), matrix, atol=1e-6)
        assert len(got["human_readable"]) == 16


def test_reset_inside_a_sequence(spark):
    found = sq.build_sequences(frame(spark, [packet(i) for i in range(64)]), sq.SequenceRule(reset_every=40))
    assert {(r["epoch"], r["seq_no"]) for r in found.collect()} == {(0, 0), (0, 1), (1, 0)}


def test_file_order_and_falling_time(spark):
    rows = [packet(i, ts=START - timedelta(seconds=3 * i)) for i in range(16)]
    rule = sq.SequenceRule(order=["packet_id"])
    got = sq.build_sequences(frame(spark, rows), rule).first()
    assert got["mean_gap"] == pytest.approx(-3.0) and math.isnan(got["unscaled"][0][3])
    assert [h["packet_size"] for h in got["human_readable"]] == list(range(80, 96))


def test_feature_without_spread_is_centred(spark):
    got = sq.build_sequences(frame(spark, [packet(i) for i in range(16)])).first()
    assert all(row[4] == 0.0 for row in got["sequence"])


def test_scaler_scopes(spark):
    rule = sq.SequenceRule(length=4, reset_every=100)
    rows = sq.assemble(sq.place_packets(frame(spark, mixed(80)), rule), rule)
    by_join = sq.apply_scaler(rows, sq.fit_scaler(rows, "first")).orderBy("epoch", "seq_no").collect()
    by_window = sq.scale_by_first(rows, rule).orderBy("epoch", "seq_no").collect()
    assert len(by_join) == len(by_window)
    for a, b in zip(by_join, by_window):
        np.testing.assert_allclose(np.array(a["sequence"]), np.array(b["sequence"]), atol=1e-9)


@pytest.mark.parametrize(
    "proto, name", [(6, "TCP"), (17, "UDP"), (1, "ICMP"), (2, "IGMP"), (47, "Unknown"), (None, None)]
)
def test_one_packet_of_each_protocol(spark, proto, name):
    found = featurize.featurize(frame(spark, [packet(3, proto=proto)])).collect()
    if proto is None:
        assert found == []
        return
    row, human = found[0], found[0]["human_readable"]
    assert human["protocol"] == name and row["f10"] == -1.0
    assert row["f0"] == pytest.approx((10 * 2**24 + 3) / (2**32 - 1) * 2 - 1)
    assert row["f11"] == pytest.approx(math.log1p(83) / math.log1p(65535) * 2 - 1)
    if proto == 6:
        assert (human["tcp_flags"], human["window"], human["udp_len"]) == (18, 503, None)
        assert row["f8"] == pytest.approx(18 / 127.5 - 1)
    elif proto == 17:
        assert (human["udp_len"], human["tcp_flags"], row["f9"]) == (30, None, -1.0)
    else:
        assert (human["src_port"], human["flags_or_len"], row["f6"], row["f9"]) == (0, 0, -1.0, -1.0)


@pytest.mark.parametrize("ip", ["10.0.0.256", "10.0.0", "x.1.1.1", "", "10.0.0.01", None])
def test_unreadable_address_drops_the_packet(spark, ip):
    assert featurize.featurize(frame(spark, [packet(1, src_ip=ip)])).count() == 0


def test_missing_field_drops_the_packet(spark):
    assert featurize.featurize(frame(spark, [packet(1, tcp_window=None)])).count() == 0
    assert featurize.featurize(frame(spark, [packet(1, proto=17, udp_len=None)])).count() == 0


def test_latest_sequence_needs_enough_packets(spark):
    rows = [packet(i) for i in range(20)] + [packet(100 + i, "b") for i in range(3)]
    got = sq.latest_sequence(frame(spark, rows), sq.SequenceRule(length=4), F.col("packet_id"))
    assert {r["sensor_id"]: r["sequence"] for r in got.collect()} == {"a": [16, 17, 18, 19], "b": None}


def test_training_windows_literal_and_ordered_agree(spark):
    rows = [packet(i) for i in range(200)]
    packets = frame(spark, rows).drop("is_training")
    spans = [(START + timedelta(seconds=a), START + timedelta(seconds=b)) for a, b in [(3, 9), (5, 6), (40, 45), (44, 90)]]
    windows = spark.createDataFrame(spans, "start timestamp, end timestamp")
    wanted = {r["packet_id"]: any(a <= r["ts"] <= b for a, b in spans) for r in rows}
    for literal, size in ((100, 10**6), (1, 10**6), (1, 30)):
        got = featurize.label_training(packets, windows, literal_windows=literal, rows_per_split=size)
        assert {r["packet_id"]: r["is_training"] for r in got.collect()} == wanted


def test_feature_names_match(spark):
    assert list(feature_columns()) == FEATURES
