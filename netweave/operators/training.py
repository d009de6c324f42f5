"""Training as one operation: split, fit, choose the rank by validation loss, set the threshold, save.

Call shape: sequences with ``_id`` and ``sequence`` in, a version of the model store out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators import scoring as sc
from netweave.plans.ordering import ROWS_PER_SPLIT
from netweave.schemas import NORMAL_SHARE, PATIENCE
from netweave.session import settled
from netweave.sources.models import ModelStore


@dataclass(frozen=True)
class TrainingRule:
    """``seed`` None takes the sequences in the order of their ids, which are hashes themselves."""

    max_rank: int = 8
    share: float = sc.TRAIN_SHARE
    patience: int = PATIENCE
    normal_share: float = NORMAL_SHARE
    seed: int | None = None
    rows_per_split: int = ROWS_PER_SPLIT


@dataclass(frozen=True)
class Trained:
    """The best model with its validation loss, its threshold, and (rank, loss) of all ranks that were tried."""

    model: sc.SubspaceModel
    validation_loss: float
    threshold: float
    history: list[tuple[int, float]]


def train(sequences: DataFrame, rule: TrainingRule | None = None) -> Trained:
    """Fit on a share of the sequences, validate on the rest.

    The sequences are read from one stored copy: once for the split, twice for the fit and once for the errors of all
    ranks. Rows whose matrix has a null or a wrong shape are left out. Fewer than two sequences cannot be split: ValueError.
    """
    rule = rule or TrainingRule()
    numbers = F.flatten("sequence")
    whole = (F.size(numbers) == sc.CELLS) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x))
    rows = settled(sequences.select("_id", "sequence").filter(F.coalesce(whole, F.lit(False))), "training-sequences")
    if rule.seed is None:
        parted = sc.split_exact(rows, ["_id"], rule.share, rule.rows_per_split)
    else:
        parted = sc.split_random(rows, rule.share, rule.seed)
    fitted = sc.fit_directions(parted.filter("is_train"), rule.max_rank)
    errors = parted.filter("not is_train").select("_id", fitted.prefix_scorer()(F.flatten("sequence")).alias("errors"))
    errors = settled(errors, "validation-errors")
    rank, history = sc.best_rank(sc.rank_losses(errors, fitted.rank + 1, ["_id"], rule.rows_per_split), rule.patience)
    own = errors.select("_id", F.get("errors", F.lit(rank)).alias("reconstruction_error"))
    limit = sc.dynamic_threshold(own, rule.normal_share, rows_per_split=rule.rows_per_split).first()
    if limit is None:
        raise ValueError("there are no validation sequences")
    return Trained(fitted.first(rank), history[rank][1], limit["threshold"], history)


def train_and_save(sequences: DataFrame, store: ModelStore, created_at: str, rule: TrainingRule | None = None) -> tuple[str, Trained]:
    """Train and register; the version is the best one if its validation loss is below that of all before."""
    trained = train(sequences, rule)
    return store.save(trained.model, trained.validation_loss, created_at, trained.threshold), trained


def score_by_version(sequences: DataFrame, store: ModelStore, version: str = "best", threshold: float | None = None) -> DataFrame:
    """Add ``model_version``, ``reconstruction_error`` and ``is_anomaly``.

    Without a ``threshold`` that of the model counts, and for the untrained model the fixed one.
    """
    loaded = store.load(version)
    limit = threshold if threshold is not None else loaded.threshold if loaded.threshold is not None else sc.ANOMALY_THRESHOLD
    scored = sc.score_by_subspace(sequences, loaded.model)
    return scored.withColumns(
        {"model_version": F.lit(loaded.version).cast("string"), "is_anomaly": sc.flag(F.col("reconstruction_error"), limit)}
    )
