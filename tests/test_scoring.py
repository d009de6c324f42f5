"""Losses, thresholds, splits, models and the registry on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.functions import losses
from netweave.operators import registry as rg
from netweave.operators import scoring as sc


def matrices(spark, n=60, seed=2, rank=3):
    rnd = np.random.default_rng(seed)
    basis = rnd.normal(size=(rank, 192))
    data = rnd.normal(size=(n, rank)) @ basis + 5
    rows = [(f"m{i:03d}", m.reshape(16, 12).tolist()) for i, m in enumerate(data)]
    return spark.createDataFrame(rows, "_id string, sequence array<array<double>>").repartition(3), data


def smooth(d):
    d = np.abs(d)
    return np.where(d < 1, d * d / 2, d - 0.5)


@pytest.mark.parametrize("x, y, loss", [(0.0, 0.5, 0.125), (0.0, 1.0, 0.5), (0.0, -3.0, 2.5), (2.0, 2.0, 0.0)])
def test_smooth_l1(spark, x, y, loss):
    assert spark.range(1).select(losses.smooth_l1(F.lit(x), F.lit(y))).first()[0] == pytest.approx(loss)


def test_rank_zero_is_the_mean(spark):
    rows, data = matrices(spark)
    scored = {r["_id"]: r["reconstruction_error"] for r in sc.score_by_mean(rows, sc.mean_model(rows)).collect()}
    wanted = smooth(data - data.mean(axis=0)).mean(axis=1)
    assert [scored[f"m{i:03d}"] for i in range(60)] == pytest.approx(wanted.tolist())
    again = sc.score_by_subspace(rows, sc.fit_subspace(rows, 0))
    assert {r["_id"]: r["reconstruction_error"] for r in again.collect()} == pytest.approx(scored)


def test_error_falls_with_rank_to_zero(spark):
    rows, _ = matrices(spark)
    means = [
        sc.score_by_subspace(rows, sc.fit_subspace(rows, k)).agg(F.avg("reconstruction_error")).first()[0] for k in (0, 1, 3)
    ]
    assert means[0] > means[1] > means[2] and means[2] == pytest.approx(0, abs=1e-9)


def test_rank_sweep_stops_and_keeps_the_best(spark):
    rows, _ = matrices(spark)
    parts = sc.split_random(rows, seed=1).cache()
    model, history = sc.rank_sweep(parts.filter("is_train"), parts.filter("not is_train"), 4, patience=1)
    assert [k for k, _ in history] == list(range(len(history)))
    assert model.rank == min(history, key=lambda h: h[1])[0] and model.rank >= 3


@pytest.mark.parametrize("n, index", [(10, 9), (11, 9), (1, 0), (20, 18)])
@pytest.mark.parametrize("size", [10**6, 3])
def test_dynamic_threshold_position(spark, n, index, size):
    rows = spark.createDataFrame([(f"m{i}", float(i)) for i in range(n)], "_id string, reconstruction_error double")
    found = sc.dynamic_threshold(rows, rows_per_split=size).collect()
    assert [r["threshold"] for r in found] == [float(index)]


def test_threshold_with_one_very_common_error(spark):
    values = [0.25] * 400 + [0.1] * 100 + [0.9] * 50
    rows = spark.createDataFrame([(f"m{i:04d}", v) for i, v in enumerate(values)], "_id string, reconstruction_error double")
    assert sc.dynamic_threshold(rows, 0.5, rows_per_split=40).first()[0] == sorted(values)[275]


def test_threshold_of_nothing(spark):
    rows = spark.createDataFrame([], "_id string, reconstruction_error double")
    assert sc.dynamic_threshold(rows).count() == 0


@pytest.mark.parametrize("n", [1, 10, 11, 100])
@pytest.mark.parametrize("size", [10**6, 7])
def test_split_sizes_are_exact(spark, n, size):
    rows = spark.range(n).withColumnRenamed("id", "at")
    got = sc.split_exact(rows, ["at"], rows_per_split=size).collect()
    assert sorted(r["at"] for r in got if r["is_train"]) == list(range(int(0.8 * n)))


def test_random_split_is_repeatable(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("_id"))
    first, second, other = (sc.split_random(rows, seed=s).collect() for s in (1, 1, 2))
    train = [{r["_id"] for r in part if r["is_train"]} for part in (first, second, other)]
    assert train[0] == train[1] != train[2] and all(len(t) == 40 for t in train)


def test_three_way_split_sizes(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("_id"))
    sizes = {r["part"]: r["count"] for r in sc.split_three_ways(rows, 0.7, 0.15).groupBy("part").count().collect()}
    assert sizes["train"] == pytest.approx(14_000, rel=0.03) and sizes["test"] == pytest.approx(3_000, rel=0.1)


@pytest.mark.parametrize("size", [10**6, 20])
def test_batch_means_weigh_batches_equally(spark, size):
    rows = spark.range(70).select(F.col("id").alias("at"), F.col("id").cast("double").alias("reconstruction_error"))
    batches = sc.batch_losses(rows, ["at"], rows_per_split=size)
    assert [(r["batch_no"], r["rows"]) for r in batches.orderBy("batch_no").collect()] == [(0, 32), (1, 32), (2, 6)]
    assert sc.validation_loss(batches).first()[0] == pytest.approx((15.5 + 47.5 + 66.5) / 3)


def test_no_batch_means_zero(spark):
    rows = spark.createDataFrame([], "at long, reconstruction_error double")
    assert sc.validation_loss(sc.batch_losses(rows, ["at"])).first()[0] == 0.0


def test_empty_class_and_empty_confusion(spark):
    rows = spark.createDataFrame([(0, 0.5), (0, 1.5)], "target int, reconstruction_error double")
    assert tuple(sc.classwise_error(rows).first()) == (1.0, 0.0)
    empty = spark.createDataFrame([], "p boolean, a boolean")
    found = sc.confusion_metrics(empty, F.col("p"), F.col("a")).first()
    assert found["tp"] == 0 and found["precision"] is None


@pytest.mark.parametrize("size", [10**6, 4])
def test_early_stopping(spark, size):
    runs = {
        "flat": [1.0] * 9,
        "down": [9.0 - i for i in range(9)],
        "late": [5, 4, 6, 6, 6, 6, 3, 7, 7, 7, 7, 7, 1],
        "tie": [2, 2, 2, 2, 2, 1],
    }
    rows = [(r, i + 1, float(v)) for r, vs in runs.items() for i, v in enumerate(vs)]
    metrics = spark.createDataFrame(rows, "run_id string, step long, val_loss double")
    got = {r["run_id"]: tuple(r)[1:] for r in sc.early_stopping(metrics, rows_per_split=size).collect()}
    assert got == {
        "flat": (6, 6, 1, 1.0),
        "down": (None, 9, 9, 1.0),
        "late": (12, 12, 7, 3.0),
        "tie": (None, 6, 6, 1.0),
    }


def test_flag_is_inclusive(spark):
    assert [r[0] for r in spark.createDataFrame([(0.5,), (0.49,)], "e double").select(sc.flag(F.col("e"), 0.5)).collect()] == [True, False]


def test_registry_versions_and_lookup(spark):
    registry = rg.empty_registry(spark)
    assert tuple(rg.pointers(registry).first()) == (None, None)
    for i, best in enumerate([False, True, False]):
        registry = rg.append_version(registry, f"/m/{i}", 0.5 - i / 10, "2024-01-01 00:00:00", best)
    assert tuple(rg.pointers(registry).first()) == ("v3", "v2")
    asked = spark.createDataFrame([("latest",), ("best",), ("v1",), ("v9",), (None,)], "requested string")
    got = {r["requested"]: (r["checkpoint_path"], r["untrained"]) for r in rg.resolve(asked, registry).collect()}
    assert got == {"latest": ("/m/2", False), "best": ("/m/1", False), "v1": ("/m/0", False), "v9": (None, True), None: (None, True)}
    plain = rg.append_version(rg.empty_registry(spark), "/m/0", 0.5, "2024-01-01 00:00:00", False)
    assert rg.resolve(asked.filter("requested = 'best'"), plain).first()["checkpoint_path"] == "/m/0"


def test_newest_checkpoint_in_a_folder(spark, tmp_path):
    import os

    assert rg.newest_checkpoint(rg.list_checkpoints(spark, str(tmp_path))).first()[0] is None
    for i, name in enumerate(["b.pth", "a.pth", "c.txt"]):
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    assert rg.newest_checkpoint(rg.list_checkpoints(spark, str(tmp_path))).first()[0].endswith("a.pth")
