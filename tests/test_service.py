"""Buckets, the merged store, saved models, training, scoring by version and the sequencer's kept state."""

import datetime as dt
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import views
from netweave.operators import scoring as sc
from netweave.operators import sequencing as sq
from netweave.operators import training as tr
from netweave.plans.ordering import rows_between
from netweave.schemas import PACKET
from netweave.sources import files, topics
from netweave.sources.buckets import BUCKET, BucketedTable
from netweave.sources.deliveries import TopicWriter
from netweave.sources.models import ModelStore
from netweave.sources.sinks import latest_per_id
from netweave.sources.store import DocumentStore
from netweave.sources.tables import packets, stage_log
from netweave.streaming import flows
from netweave.streaming.health import StageListener
from netweave.streaming.scoring import ScoringStage
from netweave.streaming.sequencer import MicroBatchSequencer
from netweave.streaming.windows import WindowLabeller
from tests.test_scoring import matrices, smooth


def spoil(path):
    """Make every data file below a folder unreadable."""
    found = [f for f in path.rglob("*.parquet")]
    for f in found:
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
        f.write_bytes(b"no table")
    return found


# ---------------------------------------------------------------- files and buckets


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "a" / "x.json")
    assert files.names(spark, str(tmp_path / "a")) == [] and not files.exists(spark, path)
    assert files.write_new(spark, path, "one") and not files.write_new(spark, path, "two")
    assert files.read_text(spark, path) == "one"
    files.write_text(spark, path, "thrée")
    assert files.read_text(spark, path) == "thrée" and [n for n in files.names(spark, str(tmp_path / "a")) if not n.startswith(".")] == ["x.json"]
    files.delete(spark, path)
    assert not files.exists(spark, path)


def test_one_of_many_writers_succeeds(spark, tmp_path):
    path, won = f"file:{tmp_path}/x", []
    files.write_text(spark, f"{tmp_path}/other", "")
    writers = [threading.Thread(target=lambda i=i: won.append(i) if files.write_new(spark, path, str(i)) else None) for i in range(8)]
    [w.start() for w in writers], [w.join() for w in writers]
    assert len(won) == 1 and files.read_text(spark, path) == str(won[0])


def test_commits_replace_only_their_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(None, 0), *((f"k{i}", i) for i in range(40))], "k string, n int")
    table = BucketedTable(str(tmp_path), "k", rows.schema, buckets=5)
    assert table.read(spark).count() == 0
    table.replace(rows, 0, table.touched(rows))
    some = rows.filter("k = 'k3'").withColumn("n", F.lit(-1))
    (touched,) = table.touched(some)
    assert spoil(tmp_path / "data" / "commit=0" / f"{BUCKET}={(touched + 1) % 5}")
    before = table.read(spark, [touched])
    kept = before.filter("k <> 'k3'").unionByName(some)
    table.replace(kept, 1, [touched])
    assert table.read(spark, [touched]).count() == before.count() and table.read(spark, [touched]).filter("n = -1").count() == 1
    assert table.read(spark, [touched], before=1).filter("n = -1").count() == 0
    with pytest.raises(RuntimeError, match="new folder"):
        table.replace(kept, 0, [touched])


def test_emptied_buckets_and_old_commits_go(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    table = BucketedTable(str(tmp_path), "k", rows.schema, buckets=1)
    for commit in range(4):
        table.replace(rows.withColumn("n", F.lit(commit)), commit, [0])
    assert table.read(spark).collect()[0]["n"] == 3 and table.read(spark, before=3).collect()[0]["n"] == 2
    left = sorted(p.parent.name for p in (tmp_path / "data").rglob(f"{BUCKET}=0"))
    assert left == ["commit=2", "commit=3"] or left == ["commit=1", "commit=2", "commit=3"]
    table.replace(rows.limit(0), 4, [0])
    assert table.read(spark).count() == 0 and table.versions(spark) == {}


# ---------------------------------------------------------------- store


@pytest.mark.parametrize("spread", [1, 5])
def test_store_has_one_document_per_id_without_a_shuffle(spark, small, tmp_path, spread):
    rows = stage_log(spark, small).unionByName(stage_log(spark, small).limit(3).withColumn("_id", F.lit(None).cast("string")))
    store = DocumentStore(str(tmp_path), rows.schema, buckets=7, spread=spread)
    parts = [rows.filter(F.pmod(F.hash("timestamp"), F.lit(3)) == i) for i in range(3)]
    for number, part in enumerate(parts):
        store(part, number)
    store(parts[-1], 2)
    key = lambda r: str(r["_id"])
    assert sorted(store.read(spark).collect(), key=key) == sorted(latest_per_id(rows).select(*rows.columns).collect(), key=key)
    plan = store.read(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_store_reads_only_the_buckets_of_a_batch(spark, small, tmp_path):
    rows = stage_log(spark, small)
    store = DocumentStore(str(tmp_path), rows.schema, buckets=16)
    store(rows, 0)
    late = rows.limit(1).withColumn("timestamp", F.col("timestamp") + F.expr("interval 1 year")).withColumn("stage", F.lit("late"))
    one = spark.createDataFrame(late.collect(), rows.schema)
    (touched,) = store.table.touched(one)
    for bucket in set(store.table.versions(spark)) - {touched}:
        assert spoil(tmp_path / "data" / "commit=0" / f"{BUCKET}={bucket}")
    store(one, 1)
    assert store.table.read(spark, [touched]).filter("stage = 'late'").count() == 1


# ---------------------------------------------------------------- training and models


def test_all_ranks_at_once_equal_single_fits(spark):
    rows, data = matrices(spark, n=80, rank=4)
    model = sc.fit_directions(rows, 5)
    np.testing.assert_allclose(model.mean, data.mean(axis=0), atol=1e-9)
    errors = {r["_id"]: r["errors"] for r in rows.select("_id", model.prefix_scorer()(F.flatten("sequence")).alias("errors")).collect()}
    for rank in (0, 1, 3, 5):
        again = sc.score_by_subspace(rows, sc.fit_subspace(rows, rank)).collect()
        assert {r["_id"]: r["reconstruction_error"] for r in again} == pytest.approx({i: e[rank] for i, e in errors.items()}, abs=1e-7)
        own = {r["_id"]: r["reconstruction_error"] for r in sc.score_by_subspace(rows, model.first(rank)).collect()}
        assert own == pytest.approx({i: e[rank] for i, e in errors.items()}, abs=1e-9)
    assert model.explained == sorted(model.explained, reverse=True) and sum(model.explained[:4]) == pytest.approx(1)


@pytest.mark.parametrize(
    "losses, patience, best, looked_at",
    [([3.0, 2.0, 1.0], 5, 2, 3), ([3.0, 3.0, 2.0], 1, 0, 2), ([1.0, 2.0, 0.5, 3.0, 4.0], 2, 2, 5), ([1.0, 2.0, 3.0, 0.1], 2, 0, 3), ([1.0], 5, 0, 1)],
)
def test_stopping(losses, patience, best, looked_at):
    found, history = sc.best_rank(losses, patience)
    assert found == best and history == list(enumerate(losses))[:looked_at]


@pytest.mark.parametrize("size", [10**6, 9])
def test_training_by_hand(spark, size):
    rows, data = matrices(spark, n=101, rank=3)
    broken = spark.createDataFrame([("n0", None), ("n1", [[1.0]]), ("n2", [[None] * 12] * 16), ("n3", [[float("nan")] * 12] * 16)], rows.schema)
    trained = tr.train(rows.unionByName(broken), tr.TrainingRule(max_rank=5, patience=2, rows_per_split=size))
    mean = data[:80].mean(axis=0)
    _, _, directions = np.linalg.svd(data[:80] - mean, full_matrices=False)
    losses = []
    for rank in range(6):
        rest = (data[80:] - mean) - (data[80:] - mean) @ directions[:rank].T @ directions[:rank]
        errors = smooth(rest).mean(axis=1)
        losses.append((errors, errors[:21].mean()))
    assert [loss for _, loss in trained.history] == pytest.approx([x for _, x in losses[: len(trained.history)]], abs=1e-7)
    assert trained.model.rank >= 3 and trained.validation_loss == min(loss for _, loss in trained.history)
    assert trained.threshold == pytest.approx(sorted(losses[trained.model.rank][0])[int(21 * 0.9)], abs=1e-7)
    with pytest.raises(ValueError):
        tr.train(rows.limit(1))
    with pytest.raises(ValueError):
        tr.train(rows.limit(0))


def test_random_parts_are_seeded(spark):
    rows, _ = matrices(spark, n=40)
    one, two = (tr.train(rows, tr.TrainingRule(max_rank=1, seed=4)) for _ in range(2))
    assert one.validation_loss == pytest.approx(two.validation_loss) and one.history[0][1] != pytest.approx(tr.train(rows, tr.TrainingRule(max_rank=1, seed=5)).history[0][1])


def test_save_resolve_load_score(spark, tmp_path):
    rows, data = matrices(spark, n=60)
    store = ModelStore(spark, str(tmp_path / "models"))
    untrained = tr.score_by_version(rows, store)
    got = {r["_id"]: (r["reconstruction_error"], r["model_version"]) for r in untrained.collect()}
    assert got["m000"] == (pytest.approx(smooth(data[0]).mean()), None)
    version, trained = tr.train_and_save(rows, store, "2024-02-01T00:00:00Z", tr.TrainingRule(max_rank=4))
    worse = store.save(sc.untrained_model(), 9.5, "2024-02-02T00:00:00Z", threshold=1.25)
    assert (version, worse) == ("v1", "v2")
    kept = {r["version"]: r for r in store.registry().collect()}
    assert kept["v1"]["is_best"] and not kept["v2"]["is_best"] and kept["v1"]["rank"] == trained.model.rank and kept["v1"]["creation_date"].isoformat().startswith("2024-02-01")
    assert [store.load(x).version for x in ("best", "latest", "v1", "v9")] == ["v1", "v2", "v1", None]
    loaded = store.load("best")
    assert loaded.threshold == pytest.approx(trained.threshold)
    wanted = {r["_id"]: r["reconstruction_error"] for r in sc.score_by_subspace(rows, trained.model).collect()}
    scored = tr.score_by_version(rows, store).collect()
    assert {r["_id"]: r["reconstruction_error"] for r in scored} == pytest.approx(wanted, abs=1e-12)
    assert all(r["is_anomaly"] == (r["reconstruction_error"] >= loaded.threshold) for r in scored)
    files.delete(spark, kept["v1"]["checkpoint_path"])
    assert store.load("v1").version is None


def test_concurrent_saves_get_different_versions(spark, tmp_path):
    store, found = ModelStore(spark, str(tmp_path)), []
    writers = [threading.Thread(target=lambda i=i: found.append(store.save(sc.untrained_model(), float(i), "2024-02-01T00:00:00Z"))) for i in range(4)]
    [w.start() for w in writers], [w.join() for w in writers]
    assert sorted(found) == ["v1", "v2", "v3", "v4"]
    assert sorted(r["version"] for r in store.registry().collect()) == sorted(found)


# ---------------------------------------------------------------- scoring stage


def record(i, cell=0.5, **other):
    doc = {"_id": f"m{i}", "timestamp": "2024-01-01T00:00:00Z", "sequence": [[cell] * 12] * 16, "is_training": False, "familiarity": 0.5, **other}
    return (doc["_id"], json.dumps(doc), dt.datetime(2024, 1, 1))


def test_a_version_saved_meanwhile_scores_the_next_batch(spark, tmp_path):
    source = str(tmp_path / "processed")
    store = ModelStore(spark, str(tmp_path / "models"))
    stage = ScoringStage(store, str(tmp_path / "out"), str(tmp_path / "rejects"), threshold=None)

    def arrive(*records):
        spark.createDataFrame(list(records), "key string, value string, record_ts timestamp").coalesce(1).write.mode("append").parquet(source)
        flows.start_batches(topics.stream_topic(spark, source), stage, str(tmp_path / "check")).awaitTermination()

    arrive(record(1), record(2, cell=2.0))
    store.save(sc.SubspaceModel(np.full(192, 2.0), np.zeros((192, 0))), 0.5, "2024-02-01T00:00:00Z", threshold=0.25)
    holed = [[0.5] * 12] * 15 + [[0.5] * 11 + [None]]
    arrive(record(3), record(4, cell=2.0), record(5, sequence=holed), record(6, sequence=[[1.0]]), ("x", "{broken", dt.datetime(2024, 1, 1)))
    rows = {json.loads(r["value"])["_id"]: json.loads(r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {i: (d["reconstruction_error"], d["is_anomaly"], d["model_version"]) for i, d in rows.items()} == {
        "m1": (0.125, False, None), "m2": (1.5, True, None), "m3": (1.0, True, "v1"), "m4": (0.0, False, "v1"),
    }
    refused = {r["key"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()}
    assert refused == {"m5": "no_score", "m6": "sequence_length", "x": "malformed"}


# ---------------------------------------------------------------- sequencer state


def test_a_batch_of_one_sensor_leaves_other_state_unread(spark, small, tmp_path):
    rule = sq.SequenceRule(reset_every=100)
    table = packets(spark, small).withColumn("ts", F.col("ts").cast("timestamp")).select(*PACKET.fieldNames())
    table = table.withColumn("is_training", F.col("ts") < F.lit(views.TRAINING_BEFORE).cast("timestamp"))
    handler = MicroBatchSequencer(str(tmp_path / "out"), str(tmp_path / "state"), rule, buckets=64)
    handler(table.filter("packet_id < 500"), 0)
    one = table.filter("packet_id >= 500 and sensor_id = 's1'")
    (touched,) = handler.table.touched(one)
    others = set(handler.table.versions(spark)) - {touched}
    assert len(others) == 3 and all(spoil(tmp_path / "state" / "data" / "commit=0" / f"{BUCKET}={b}") for b in others)
    handler(one, 1)
    wanted = sq.build_sequences(table.filter("sensor_id = 's1'"), rule).select("epoch", "seq_no", "seen", "trained", "familiarity").collect()
    got = spark.read.parquet(str(tmp_path / "out")).filter("sensor_id = 's1'").select("epoch", "seq_no", "seen", "trained", "familiarity").collect()
    assert sorted(got) == sorted(wanted) and len(got) > 5
    state = handler.table.read(spark, [touched]).first()
    assert len(state["waiting"]) < 16 and len(state["pairs"]) <= 100 and state["arrived"] == table.filter("sensor_id = 's1'").count()


def test_null_sensors_unusable_packets_and_empty_batches(spark, small, tmp_path):
    rule = sq.SequenceRule(reset_every=50)
    table = packets(spark, small).withColumn("ts", F.col("ts").cast("timestamp")).select(*PACKET.fieldNames())
    table = table.withColumn("is_training", F.col("packet_id") % 3 == 0).withColumn("sensor_id", F.when(F.col("sensor_id") != "s0", F.col("sensor_id")))
    table = table.withColumn("proto", F.when(F.col("packet_id") % 100 < 70, F.col("proto")))
    handler = MicroBatchSequencer(str(tmp_path / "out"), str(tmp_path / "state"), rule, buckets=3)
    bounds = [0, 1, 40, 40, 333, 700, 10**9]
    for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
        handler(table.filter((F.col("packet_id") >= low) & (F.col("packet_id") < high)), number)
    columns = ["sensor_id", "epoch", "seq_no", "seen", "trained", "familiarity", "is_training"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()
    assert sorted(got, key=str) == sorted(sq.build_sequences(table, rule).select(*columns).collect(), key=str) and any(r["sensor_id"] is None for r in got)


def test_stale_state_is_refused(spark, small, tmp_path):
    table = packets(spark, small).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("is_training", F.lit(False))
    handler = MicroBatchSequencer(str(tmp_path / "out"), str(tmp_path / "state"), sq.SequenceRule(reset_every=100))
    handler(table.limit(50), 0)
    handler(table.limit(50), 1)
    with pytest.raises(RuntimeError, match="new folder"):
        handler(table.limit(50), 0)


# ---------------------------------------------------------------- deliveries, health, windows


def test_a_repeated_batch_delivers_nothing_twice(spark, tmp_path):
    source = str(tmp_path / "in")
    writer = TopicWriter(str(tmp_path / "topic"))
    assert writer.read(spark).count() == 0 and writer.deliveries(spark).count() == 0
    first = spark.createDataFrame([record(i) for i in range(5)], "key string, value string, record_ts timestamp")
    writer(first, 0)
    writer(first, 0)
    first.write.parquet(source)
    flows.start_batches(topics.stream_topic(spark, source), writer, str(tmp_path / "check")).awaitTermination()
    first.limit(0).write.mode("append").parquet(source)
    writer(first.limit(2), 1)
    first.limit(3).write.parquet(str(tmp_path / "topic" / "records" / "batch=2"))  # written, but never committed
    assert sorted(r["key"] for r in writer.read(spark).collect()) == sorted([f"m{i}" for i in range(5)] + ["m0", "m1"])
    log = {r["batch"]: r["records"] for r in writer.deliveries(spark).collect()}
    assert log == {0: 5, 1: 2}


def test_a_silent_stage_grows_old(spark, tmp_path):
    from netweave.operators import serving as sv

    listener = StageListener()
    spark.streams.addListener(listener)
    try:
        for name, times in (("raw", 2), ("processed", 1)):
            source = str(tmp_path / name)
            spark.createDataFrame([record(0)], "key string, value string, record_ts timestamp").write.parquet(source)
            for _ in range(times):
                stream = topics.stream_topic(spark, source).writeStream.format("noop").queryName(name)
                stream.option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start().awaitTermination()
        deadline = dt.datetime.now() + dt.timedelta(seconds=20)
        while {r["stage"] for r in listener.stage_log(spark).collect()} != {"raw", "processed"} and dt.datetime.now() < deadline:
            pass
    finally:
        spark.streams.removeListener(listener)
    log = {r["stage"]: r for r in listener.stage_log(spark).collect()}
    assert set(log) == {"raw", "processed"} and all(r["rows"] == 1 for r in log.values())
    later = F.lit(max(r["timestamp"] for r in log.values()) + dt.timedelta(seconds=30))
    fresh = spark.createDataFrame([("raw", log["raw"]["timestamp"] + dt.timedelta(seconds=29, milliseconds=500), 2)], listener.stage_log(spark).schema)
    health = sv.stage_health(listener.stage_log(spark).unionByName(fresh), ["raw", "processed", "labeled"], later)
    assert {r["stage"]: r["status"] for r in health.collect()} == {
        "raw": "healthy", "processed": "not receiving data", "labeled": "not receiving data", "backend": "healthy",
    }


@pytest.mark.parametrize("group", [[], ["sensor_id"]])
def test_windows_added_meanwhile_count(spark, small, tmp_path, group):
    table = packets(spark, small).withColumn("ts", F.col("ts").cast("timestamp")).select(*PACKET.fieldNames())
    source, windows = str(tmp_path / "in"), str(tmp_path / "windows")
    early, late = table.filter("ts < timestamp '2024-01-10'"), table.filter("ts >= timestamp '2024-01-10'")
    handler = WindowLabeller(windows, str(tmp_path / "out"), group)

    def add(start, end):
        names = "', 's".join("0123")
        rows = spark.sql(f"select timestamp '{start}' as start, timestamp '{end}' as end, explode(array('s{names}')) as sensor_id")
        (rows if group else rows.drop("sensor_id").distinct()).write.mode("append").parquet(windows)

    def run(rows):
        rows.coalesce(1).write.mode("append").parquet(source)
        flows.start_batches(topics.stream_packets(spark, source), handler, str(tmp_path / "check")).awaitTermination()

    add("2024-01-02", "2024-01-03")
    run(early)
    add("2024-01-01", "2024-01-05")
    add("2024-01-12", "2024-01-20")
    run(late)
    wanted = table.filter("ts between '2024-01-02' and '2024-01-03' or ts between '2024-01-12' and '2024-01-20'")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == table.count()
    assert sorted(r[0] for r in got.filter("is_training").select("packet_id").collect()) == sorted(r[0] for r in wanted.select("packet_id").collect())


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("size", [10**6, 7])
def test_rows_between_two_places(spark, descending, size):
    rows = spark.createDataFrame([(i % 5, i) for i in range(100)] + [(None, 100 + i) for i in range(3)], "a int, b int")
    places = sorted(((-1 if r["a"] is None else r["a"], r["b"]) for r in rows.collect()), reverse=descending)
    for first, stop in ((0, 3), (40, 60), (95, 200), (103, 110), (5, 5)):
        got = rows_between(rows, ["a", "b"], first, stop, descending=descending, rows_per_split=size).collect()
        assert sorted((r["rank"], -1 if r["a"] is None else r["a"], r["b"]) for r in got) == [(i + 1, *p) for i, p in enumerate(places)][first:stop]


def test_deep_pages_sort_only_their_pieces(spark):
    from netweave.operators import serving as sv

    rows = spark.range(5000).select(F.concat(F.lit("m"), "id").alias("_id"), F.expr("timestamp '2024-01-01' + make_interval(0,0,0,0,0,0,id)").alias("timestamp"))
    deep = sv.deep_page(rows, 450, 10, rows_per_split=300)
    assert [r["_id"] for r in sorted(deep.collect(), key=lambda r: r["place"])] == [r["_id"] for r in sv.page(rows, 450, 10).collect()]
    assert "TakeOrdered" not in deep._jdf.queryExecution().executedPlan().toString()
    assert sv.deep_page(rows, 501, 10, rows_per_split=300).count() == 0
