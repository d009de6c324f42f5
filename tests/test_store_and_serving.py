"""Store, pages, feedback, message checks and display text on hand-made rows."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netweave.functions import text as tx
from netweave.operators import featurize, quality as ql, serving as sv
from netweave.sources import sinks, topics

DAY = datetime(2024, 1, 1)


def documents(spark, n=100):
    rows = [(f"m{i % 40}", i % 5, DAY + timedelta(hours=i % 60), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "_id string, stage_rank int, timestamp timestamp, x double")


def test_store_prunes_days_and_reads_ranges(spark, tmp_path):
    rows = documents(spark)
    path = str(tmp_path / "store")
    sinks.write_collection(rows, path)
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-02 00:00:00", "2024-01-02 23:00:00"))
    read = sinks.read_collection(spark, path, start, end)
    assert read.count() == rows.filter((F.col("timestamp") >= start) & (F.col("timestamp") <= end)).count() > 0
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan
    assert {p.name for p in (tmp_path / "store").glob("day=*")} == {"day=2024-01-01", "day=2024-01-02", "day=2024-01-03"}


def test_latest_per_id_with_ties(spark):
    rows = spark.createDataFrame(
        [("a", 1, DAY, 1.0), ("a", 3, DAY, 2.0), ("a", 2, DAY - timedelta(days=1), 3.0), ("b", 0, DAY, 4.0)],
        "_id string, stage_rank int, timestamp timestamp, x double",
    )
    assert {r["_id"]: r["x"] for r in sinks.latest_per_id(rows).collect()} == {"a": 2.0, "b": 4.0}


def test_pages_tile_the_result(spark):
    rows = documents(spark, 37).withColumn("_id", F.concat("_id", F.col("x").cast("string")))
    pages = [[r["_id"] for r in sv.page(rows, p, 10).collect()] for p in range(1, 6)]
    assert [len(p) for p in pages] == [10, 10, 10, 7, 0]
    assert len({i for p in pages for i in p}) == 37
    assert tuple(sv.page_totals(rows, 10).first()) == (37, 4)
    assert tuple(sv.page_totals(rows.filter("x < 0"), 10).first()) == (0, 0)


def anomalies(spark):
    rows = [("a", DAY, 0.7), ("b", DAY, 0.8), ("b", DAY + timedelta(hours=1), 0.9), ("c", DAY, 0.6)]
    return spark.createDataFrame(rows, "_id string, timestamp timestamp, reconstruction_error double")


def test_feedback(spark):
    marks = spark.createDataFrame([("b", DAY), ("b", DAY + timedelta(days=1)), ("zz", DAY), (None, DAY)], "_id string, marked_at timestamp")
    rows = anomalies(spark)
    labelled = sv.labeled_records(rows, marks).collect()
    assert [(r["_id"], r["reconstruction_error"], r["is_false_positive"], r["is_anomaly"]) for r in labelled] == [("b", 0.8, True, False)]
    assert sorted(r["_id"] for r in sv.without_false_positives(rows, marks).collect()) == ["a", "c"]
    assert {(r["_id"], r["reason"]) for r in sv.refused_marks(rows, marks).collect()} == {("zz", "not_found"), (None, "missing_id")}


def test_list_difference_keeps_unmatched_duplicates(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (3, "y")], "a int, b string")
    gone = spark.createDataFrame([(1, None), (3, "z")], "a int, b string")
    assert sorted((r["a"], r["b"]) for r in sv.list_difference(rows, gone).collect()) == [(2, "x"), (2, "x"), (3, "y")]


def test_newest_kept_and_merge(spark):
    rows = anomalies(spark)
    assert [r["reconstruction_error"] for r in sv.newest_kept(rows, 1).collect()] == [0.9]
    assert [r["batch"] for r in sv.merge_newest_first(rows, rows, 5).collect()] == [0, 0, 0, 0, 1]
    assert sv.push_payload(rows, 2).select("total").distinct().first()[0] == 4


def test_unknown_job(spark):
    status = spark.createDataFrame([("j", DAY, "running", 50, "half")], "job_id string, event_ts timestamp, status string, progress int, message string")
    got = {r["job_id"]: tuple(r)[1:] for r in sv.job_states(spark.createDataFrame([("j",), ("k",)], "job_id string"), status).collect()}
    assert got == {"j": ("running", 50, "half"), "k": ("not_found", 0, "Job not found")}


def test_message_round_trip_and_nulls(spark):
    rows = spark.createDataFrame([("a", DAY, None), ("b", DAY + timedelta(microseconds=5), 0.5)], "_id string, timestamp timestamp, reconstruction_error double")
    topic = topics.to_topic(rows)
    assert '"reconstruction_error":null' in topic.filter("key = 'a'").first()["value"]
    back = ql.readable_messages(topic).select("_id", "timestamp", "reconstruction_error")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_reject_reasons(spark):
    keys = '"timestamp":null,"human_readable":[],"is_training":true,"is_anomaly":false,"is_false_positive":false,"reconstruction_error":null'
    values = ["{", "[]", '{"_id":1}', f'{{"_id":"a","sequence":[],"familiarity":null,{keys}}}', f'{{"_id":"a","sequence":"x","familiarity":null,{keys}}}']
    log = spark.createDataFrame([(v, DAY) for v in values], "value string, record_ts timestamp")
    got = [r["reason"] for r in ql.checked(log, ql.raw_reason()).collect()]
    assert got == ["malformed", "malformed", "missing_key", "sequence_length", "bad_type"]
    assert ql.rejected_messages(ql.checked(log, ql.raw_reason()), "raw").count() == 5


def test_message_is_parsed_once(spark):
    log = spark.createDataFrame([("{}", DAY)], "value string, record_ts timestamp")
    plan = ql.valid_messages(ql.checked(log, ql.raw_reason()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_width_check_can_raise(spark):
    rows = spark.createDataFrame([([0.0] * 12,), ([0.0] * 11,), (None,)], "features array<double>")
    assert featurize.well_sized(rows).count() == 1
    with pytest.raises(Exception, match="12 features"):
        featurize.well_sized(rows, strict=True).collect()


@pytest.mark.parametrize("text, number", [("7", 7.0), ("7.5", 7.5), ("x", 0.0), (None, 0.0), ("-3", -3.0), ("1e3", 1000.0)])
def test_safe_number(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(featurize.safe_number(F.col("t"))).first()[0] == number


def test_text_helpers(spark):
    one = spark.createDataFrame([(None, "abcdefghijklm", "abcdefghijkl", bytes([104, 255]))], "n string, long string, exact string, data binary")
    row = one.select(
        tx.truncate_text(F.col("n")).alias("a"),
        tx.truncate_text(F.col("long")).alias("b"),
        tx.truncate_text(F.col("exact")).alias("c"),
        tx.time_of_day(F.lit(None).cast("timestamp")).alias("d"),
        tx.four_decimals(F.lit(0.0), True).alias("e"),
        tx.four_decimals(F.lit(0.0), False).alias("f"),
        tx.parse_iso(F.lit("2024-01-01T10:00:00Z")).alias("g"),
        tx.parse_iso(F.lit("soon")).alias("h"),
        tx.format_iso(F.lit("2024-01-01 10:00:00").cast("timestamp")).alias("i"),
        tx.capitalise_first(F.lit("")).alias("j"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ("", "abcdefghijkl...", "abcdefghijkl", "")
    assert (row["e"], row["f"], row["h"], row["i"], row["j"]) == ("N/A", "0.0000", None, "2024-01-01T10:00:00", "")
    assert row["g"] is not None


def test_bytes_that_are_not_text(spark):
    row = spark.createDataFrame([(bytes([104, 255, 105]),)], "data binary").select(tx.utf8(F.col("data"))).first()
    assert row[0] == "h�i"


def test_training_export(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s", 0, 0, [[0.5]], True), ("b", "s", 0, 1, [[0.5]], False)], "_id string, sensor_id string, epoch long, seq_no long, sequence array<array<double>>, is_training boolean")
    sinks.export_training_set(rows, str(tmp_path / "train"))
    assert [r["_id"] for r in spark.read.parquet(str(tmp_path / "train")).collect()] == ["a"]


def test_materialise_uses_the_shared_folder(spark):
    from netweave.session import materialise, shared_folder

    kept = materialise(spark.range(3), "step")
    assert kept.count() == 3 and all(shared_folder(spark) in path for path in kept.inputFiles())


def test_gap_scale_edges(spark):
    from netweave.functions.features import gap_scaled

    values = [r[0] for r in spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (-2.0,)], "g double").select(gap_scaled(F.col("g"))).collect()]
    assert values[:3] == [1.0, -1.0, -math.inf] and math.isnan(values[3])
