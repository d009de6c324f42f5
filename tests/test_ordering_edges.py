"""Cut and whole computations agree on null groups, null and NaN keys, decimals and bytes."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from netweave.operators import featurize, scoring, serving
from netweave.plans import ordering as od


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(8)
    rows = [
        (
            rnd.choice([None, "hot", "hot", "b"]), rnd.choice([None, float("nan"), float("inf"), rnd.random()]),
            rnd.choice([None, Decimal("1.50"), Decimal(rnd.randrange(99)) / 4]), rnd.choice([None, b"", bytes([rnd.randrange(256), 200])]), i,
        )
        for i in range(1500)
    ]
    return spark.createDataFrame(rows, "g string, x double, d decimal(10,2), b binary, id long").repartition(5).cache()


def plain(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("order", [["x", "id"], ["d", "id"], ["b", "id"], ["x", "d", "b", "id"]])
@pytest.mark.parametrize("descending", [False, True])
def test_pieces_equal_one_window(frame, order, descending):
    totals = {"n": od.Total("sum", F.lit(1)), "hi": od.Total("max", F.col("id"))}
    for group in ([], ["g"]):
        whole, cut = (plain(od.running(frame, order, totals, group, descending, size).collect()) for size in (10_000, 50))
        assert whole == cut and len(cut) == 1500
    whole, cut = (plain(od.first_rows(frame, order, 7, ["g"], descending, rows_per_split=size).collect()) for size in (10_000, 50))
    assert whole == cut and len(cut) == 21


def test_sliding_in_pieces(frame):
    whole, cut = (plain(od.sliding(frame, ["x", "id"], 4, F.col("id"), "last", ["g"], 20, size).collect()) for size in (10_000, 50))
    assert whole == cut and len(cut) == 1500 - 9


def test_null_errors_do_not_move_the_threshold(spark):
    rows = [(None if i % 10 == 0 else float(i), f"e{i}") for i in range(5000)]
    errors = spark.createDataFrame(rows, "reconstruction_error double, _id string")
    for size in (10_000, 300):
        assert scoring.dynamic_threshold(errors, rows_per_split=size).first()["threshold"] == 4501.0


def test_an_untrained_model_still_scores(spark):
    sequences = spark.createDataFrame([(1, [[0.5] * 12] * 16)], "id int, sequence array<array<double>>")
    model = scoring.mean_model(sequences.limit(0))
    assert scoring.score_by_mean(sequences, model).first()["reconstruction_error"] == pytest.approx(0.125)
    assert scoring.score_by_mean(sequences, model.limit(0)).first()["reconstruction_error"] == pytest.approx(0.125)


def test_an_empty_id_is_missing(spark):
    anomalies = spark.createDataFrame([("a",)], "_id string")
    marks = spark.createDataFrame([("",), (None,), ("a",), ("b",)], "_id string")
    assert sorted(r["reason"] for r in serving.refused_marks(anomalies, marks).collect()) == ["missing_id", "missing_id", "not_found"]


WINDOWS = [(None, 50), (10, None), (5, 9), (30, 20), (7, 12), (40, 41), (0, 3)]


def stamped(spark, rows, names):
    frame = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    return frame.select(*[F.timestamp_seconds(n).alias(n) if n != "packet_id" else F.col(n) for n in names])


def test_training_windows_mean_the_same_on_every_path(spark, tmp_path):
    packets = stamped(spark, [(i, i) for i in range(60)], ["packet_id", "ts"])
    windows = stamped(spark, WINDOWS, ["start", "end"])
    want = {i for i in range(60) if 5 <= i <= 12 or 40 <= i <= 41 or i <= 3}
    for literal, size in ((100, 10_000), (0, 10_000), (0, 10)):
        found = featurize.label_training(packets, windows, literal_windows=literal, rows_per_split=size)
        assert {r["packet_id"] for r in found.collect() if r["is_training"]} == want
    asked = windows.withColumn("requested_at", F.timestamp_seconds(F.lit(7)))
    found = featurize.label_training(packets, asked, literal_windows=0)
    assert {r["packet_id"] for r in found.collect() if r["is_training"]} == {i for i in want if i >= 7}

    packets.repartition(2).write.parquet(str(tmp_path / "packets"))
    windows.limit(0).write.parquet(str(tmp_path / "windows"))
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "packets"))
    known = spark.read.schema(windows.schema).parquet(str(tmp_path / "windows"))
    query = (
        featurize.label_training(stream, known, literal_windows=-1).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out"))
    )
    try:
        query.processAllAvailable()
        windows.write.mode("append").parquet(str(tmp_path / "windows"))
    finally:
        query.stop()
    packets.withColumn("packet_id", F.col("packet_id") + 100).write.mode("append").parquet(str(tmp_path / "packets"))
    known = spark.read.schema(windows.schema).parquet(str(tmp_path / "windows"))
    query = (
        featurize.label_training(stream, known, literal_windows=-1).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out"))
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 120 and {r["packet_id"] - 100 for r in rows if r["is_training"]} == want
