"""Reconstruction models over sequences: fit, score, threshold, evaluate.

Rank 0 reconstructs every sequence by the mean training sequence and stays in
column expressions. Rank k projects onto k principal components; only that
projection runs in Python, on Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions.losses import sequence_error
from netweave.plans.ordering import ROWS_PER_SPLIT, Total, ordinals, row_at, running
from netweave.schemas import (
    ANOMALY_THRESHOLD,
    FEATURE_COUNT,
    NORMAL_SHARE,
    PATIENCE,
    SCORING_BATCH,
    SEQUENCE_LENGTH,
)

# Tasks get the scorer with the job, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_SHARE = 0.8
CELLS = SEQUENCE_LENGTH * FEATURE_COUNT


def mean_model(training: DataFrame) -> DataFrame:
    """The rank-0 model: one row with the mean matrix of the training sequences."""
    rows = training.select(F.posexplode("sequence").alias("pos", "row"))
    means = F.array(*[F.avg(F.get("row", F.lit(j))) for j in range(FEATURE_COUNT)])
    by_position = rows.groupBy("pos").agg(means.alias("mean"))
    matrix = F.sort_array(F.collect_list(F.struct("pos", "mean")))
    return by_position.agg(F.transform(matrix, lambda e: e["mean"]).alias("reconstruction"))


def score_by_mean(sequences: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``reconstruction_error`` against the one-row model; without a trained model against zeros."""
    untrained = F.array_repeat(F.array_repeat(F.lit(0.0), FEATURE_COUNT), SEQUENCE_LENGTH)
    trained = model.filter(F.size("reconstruction") > 0).select("reconstruction").scalar()
    reconstruction = F.coalesce(trained, untrained)
    return (
        sequences.withColumn("_reconstruction", reconstruction)
        .withColumn("reconstruction_error", sequence_error(F.col("sequence"), F.col("_reconstruction")))
        .drop("_reconstruction")
    )


@dataclass
class SubspaceModel:
    """Mean and principal directions of flattened training sequences, at most 192 x k numbers."""

    mean: np.ndarray
    directions: np.ndarray
    explained: list[float] = field(default_factory=list)

    @property
    def rank(self) -> int:
        return self.directions.shape[1]

    def scorer(self):
        """Column function: flat sequence to mean smooth-L1 error."""
        mean, directions = self.mean, self.directions

        def errors(flat: pa.Array) -> pa.Array:
            cells = np.asarray(flat.flatten()).reshape(len(flat), len(mean))
            centred = cells - mean
            distance = np.abs(centred - (centred @ directions) @ directions.T)
            losses = np.where(distance < 1, distance**2 / 2, distance - 0.5)
            return pa.array(losses.mean(axis=1))

        errors.__annotations__ = {"flat": pa.Array, "return": pa.Array}
        return F.arrow_udf(errors, "double")


    def prefix_scorer(self):
        """Column function: flat sequence to the errors with no, one, two, ... all of the directions."""
        mean, directions = self.mean, self.directions

        def errors(flat: pa.Array) -> pa.Array:
            cells = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), len(mean))
            rest = cells - mean
            found = np.empty((len(flat), directions.shape[1] + 1))
            for rank in range(found.shape[1]):
                if rank:
                    direction = directions[:, rank - 1]
                    rest = rest - np.outer(rest @ direction, direction)
                distance = np.abs(rest)
                found[:, rank] = np.where(distance < 1, distance**2 / 2, distance - 0.5).mean(axis=1)
            ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

        errors.__annotations__ = {"flat": pa.Array, "return": pa.Array}
        return F.arrow_udf(errors, "array<double>")

    def first(self, rank: int) -> SubspaceModel:
        """The same model with the first ``rank`` directions."""
        return SubspaceModel(self.mean, self.directions[:, :rank], self.explained[:rank])


def untrained_model() -> SubspaceModel:
    """Reconstructs everything as zeros: what scores while there is no trained model."""
    return SubspaceModel(np.zeros(CELLS), np.zeros((CELLS, 0)))


def fit_directions(training: DataFrame, max_rank: int) -> SubspaceModel:
    """Mean and leading principal directions for all ranks up to ``max_rank``, from two passes over the training sequences.

    Tasks add up centred products of whole Arrow batches; Spark adds the 192 rows of each task's sum, of which
    192 x 192 numbers reach the driver.
    """
    model = mean_model(training).first()
    if model is None or not model["reconstruction"]:
        raise ValueError("there are no training sequences")
    mean = np.array(model["reconstruction"]).ravel()
    width = len(mean)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((width, width)), 0
        for batch in batches:
            centred = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - mean
            total += centred.T @ centred
            rows += len(centred)
        columns = [pa.array(np.arange(width), pa.int32()), pa.array(np.full(width, rows), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "n", "cells"])

    parts = training.select(F.flatten("sequence").alias("x")).mapInArrow(products, "i int, n long, cells array<double>")
    summed = parts.groupBy("i").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("cells", F.lit(j))) for j in range(width)]).alias("cells"))
    rows = sorted(summed.collect())
    covariance = np.array([r["cells"] for r in rows]) / max(rows[0]["n"] - 1, 1)
    values, vectors = np.linalg.eigh(covariance)
    leading = np.argsort(-values, kind="stable")[:max_rank]
    shares = values[leading] / values.sum() if values.sum() > 0 else np.zeros(len(leading))
    return SubspaceModel(mean, vectors[:, leading], [float(v) for v in shares])


def fit_subspace(training: DataFrame, rank: int) -> SubspaceModel:
    """Fit on ``training.sequence``; the covariance is summed by Spark, 192 x 192 reaches the driver."""
    flat = training.select(array_to_vector(F.flatten("sequence")).alias("x"))
    flat = flat.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mean = np.array(flat.select(Summarizer.mean(F.col("x")).alias("m")).first()["m"].toArray())
        if rank == 0:
            return SubspaceModel(mean, np.zeros((len(mean), 0)))
        fitted = PCA(k=rank, inputCol="x", outputCol="y").fit(flat)
        return SubspaceModel(mean, fitted.pc.toArray(), [float(v) for v in fitted.explainedVariance.toArray()])
    finally:
        flat.unpersist()


def score_by_subspace(sequences: DataFrame, model: SubspaceModel) -> DataFrame:
    return sequences.withColumn("reconstruction_error", model.scorer()(F.flatten("sequence")))


def flag(error: Column, threshold: Column | float = ANOMALY_THRESHOLD) -> Column:
    """An error equal to the threshold is an anomaly."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return error >= limit


def has_score() -> Column:
    error = F.col("reconstruction_error")
    return error.isNotNull() & ~F.isnan(error)


def without_score(scored: DataFrame) -> DataFrame:
    """Valid messages that the model gave no number, as for a cell that is null."""
    return scored.filter(~has_score()).withColumn("reason", F.lit("no_score"))


def to_predictions(scored: DataFrame, scored_at: Column, threshold: Column | float = ANOMALY_THRESHOLD) -> DataFrame:
    """Scored valid messages as prediction records; rows without a score are those of ``without_score``."""
    return (
        scored.filter(has_score())
        .withColumn("timestamp", scored_at)
        .withColumn("is_anomaly", flag(F.col("reconstruction_error"), threshold))
        .withColumn("is_false_positive", F.lit(False))
    )


def dynamic_threshold(
    errors: DataFrame,
    normal_share: float = NORMAL_SHARE,
    tie: str = "_id",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """The element at 0-based index floor(n * share) of the ascending errors; null errors do not count."""
    errors = errors.filter(F.col("reconstruction_error").isNotNull())
    position = F.floor(F.col("n").cast("double") * normal_share)
    found = row_at(errors.select("reconstruction_error", tie), ["reconstruction_error", tie], position, rows_per_split)
    return found.select(F.col("reconstruction_error").alias("threshold"))


def split_exact(
    rows: DataFrame,
    order: list[str],
    share: float = TRAIN_SHARE,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Flag the first floor(share * n) rows in ``order`` as training.

    The key at the border is found on the order columns alone; the rows themselves
    are then flagged in place, without a shuffle.
    """
    position = F.floor(F.col("n").cast("double") * share) - 1
    border = row_at(rows.select(*order), order, position, rows_per_split)
    last = border.select(F.struct(*order).alias("last")).scalar()
    return rows.withColumn("_last", last).withColumn(
        "is_train", F.coalesce(F.struct(*order) <= F.col("_last"), F.lit(False))
    ).drop("_last")


def _drawn(seed: int, key: str) -> Column:
    """A pseudo-random text for each key, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def split_random(rows: DataFrame, share: float = TRAIN_SHARE, seed: int = 0, key: str = "_id") -> DataFrame:
    """Exact-size split in a pseudo-random order that is the same on every run."""
    drawn = rows.withColumn("_draw", _drawn(seed, key))
    return split_exact(drawn, ["_draw", key], share).drop("_draw")


def split_three_ways(rows: DataFrame, train: float, validation: float, seed: int = 0, key: str = "_id") -> DataFrame:
    """Train, validation or test by a hash of the key; sizes are approximate."""
    draw = F.conv(F.substring(_drawn(seed, key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    part = (
        F.when(draw < train, "train").when(draw < train + validation, "validation").otherwise("test")
    )
    return rows.withColumn("part", part)


def batch_losses(
    errors: DataFrame,
    order: list[str],
    batch: int = SCORING_BATCH,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Mean error of each run of ``batch`` rows; the last batch may be smaller."""
    placed = ordinals(errors, order, "_at", rows_per_split=rows_per_split)
    return (
        placed.withColumn("batch_no", F.floor((F.col("_at") - 1) / batch).cast("long"))
        .groupBy("batch_no")
        .agg(F.avg("reconstruction_error").alias("loss"), F.count("*").alias("rows"))
    )


def validation_loss(batches: DataFrame) -> DataFrame:
    """Mean of the batch means; 0 when there is no batch."""
    return batches.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


def classwise_error(scored: DataFrame, target: str = "target") -> DataFrame:
    """Mean error per class, 0 for an empty class."""

    def mean_where(value: int) -> Column:
        return F.coalesce(F.avg(F.when(F.col(target) == value, F.col("reconstruction_error"))), F.lit(0.0))

    return scored.agg(mean_where(0).alias("normal_loss"), mean_where(1).alias("malicious_loss"))


def confusion_metrics(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    counts = rows.agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def early_stopping(metrics: DataFrame, patience: int = PATIENCE, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Per run: the step at which training stops and the best loss up to there.

    Only a strictly smaller loss improves, so the best so far is the running minimum
    of (loss, step) and the waiting time is the distance to its step.
    """
    best = Total("min", F.struct(F.col("val_loss").alias("loss"), F.col("step").alias("step")))
    tracked = running(metrics, ["step"], {"best": best}, ["run_id"], rows_per_split=rows_per_split)
    waited = F.col("step") - F.col("best.step")
    state = F.struct("step", "best")
    return (
        tracked.groupBy("run_id")
        .agg(F.min(F.when(waited >= patience, state)).alias("_stop"), F.max(state).alias("_last"))
        .withColumn("_end", F.coalesce("_stop", "_last"))
        .select(
            "run_id",
            F.col("_stop.step").alias("stopped_at"),
            F.col("_end.step").alias("steps"),
            F.col("_end.best.step").alias("best_step"),
            F.col("_end.best.loss").alias("best_loss"),
        )
    )


def rank_losses(errors: DataFrame, ranks: int, order: list[str], rows_per_split: int = ROWS_PER_SPLIT) -> list[float]:
    """Mean of the batch means for each of the first ``ranks`` entries of the array ``errors``; 0 without rows."""
    placed = ordinals(errors.select(*order, "errors"), order, "_at", rows_per_split=rows_per_split)
    batch = F.floor((F.col("_at") - 1) / SCORING_BATCH).cast("long").alias("batch_no")
    batches = placed.groupBy(batch).agg(*[F.avg(F.get("errors", F.lit(k))).alias(f"r{k}") for k in range(ranks)])
    return list(batches.agg(*[F.coalesce(F.avg(f"r{k}"), F.lit(0.0)) for k in range(ranks)]).first())


def best_rank(losses: list[float], patience: int = PATIENCE) -> tuple[int, list[tuple[int, float]]]:
    """The rank of the lowest loss before the losses stop falling, and the losses looked at."""
    best, waited = 0, 0
    for rank, loss in enumerate(losses):
        if rank and loss < losses[best]:
            best, waited = rank, 0
        elif rank:
            waited += 1
        if waited >= patience:
            break
    return best, list(enumerate(losses[: rank + 1]))


def rank_sweep(
    training: DataFrame, validation: DataFrame, max_rank: int, patience: int = PATIENCE
) -> tuple[SubspaceModel, list[tuple[int, float]]]:
    """Ranks 0, 1, ... until the validation loss stops falling; best model and history.

    All ranks share one fit, and one pass over the validation sequences gives the errors of all.
    """
    model = fit_directions(training, max_rank)
    scored = validation.select("_id", model.prefix_scorer()(F.flatten("sequence")).alias("errors"))
    best, history = best_rank(rank_losses(scored, model.rank + 1, ["_id"]), patience)
    return model.first(best), history
