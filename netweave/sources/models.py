"""Saved reconstruction models: one folder per version, committed by a marker that only one writer can create.

A writer stores the model under a name of its own, then tries to create the marker of the next version number. If
another writer was faster it takes the number after that. The markers are the registry; a version without its model
folder, or an unknown one, loads as the untrained model.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.operators import registry as rg
from netweave.operators.scoring import SubspaceModel, untrained_model
from netweave.schemas import REGISTRY
from netweave.sources import files

SAVED = T.StructType([*REGISTRY.fields, T.StructField("rank", T.IntegerType()), T.StructField("threshold", T.DoubleType())])
WEIGHTS = "mean array<double>, directions array<array<double>>, explained array<double>"


@dataclass(frozen=True)
class LoadedModel:
    """``version`` is null for the untrained model."""

    version: str | None
    model: SubspaceModel
    threshold: float | None


@dataclass(frozen=True)
class ModelStore:
    spark: SparkSession
    path: str

    def registry(self) -> DataFrame:
        """All versions, as ``operators.registry`` takes them, with rank and own threshold."""
        folder = f"{self.path}/versions"
        if not any(n.endswith(".json") for n in files.names(self.spark, folder)):
            return self.spark.createDataFrame([], SAVED)
        return self.spark.read.schema(SAVED).option("pathGlobFilter", "*.json").json(folder)

    def save(
        self, model: SubspaceModel, validation_loss: float, created_at: str, threshold: float | None = None, is_best: bool | None = None
    ) -> str:
        """Store the model and return its version.

        ``is_best`` moves the pointer to the best model; by default it does if no best model had a loss as low.
        """
        folder = f"{self.path}/models/{uuid.uuid4().hex}"
        row = (model.mean.tolist(), model.directions.T.tolist(), list(model.explained))
        self.spark.createDataFrame([row], WEIGHTS).coalesce(1).write.parquet(folder)
        while True:
            known = self.registry().agg(F.max("seq"), F.min(F.when(F.col("is_best"), F.col("validation_loss")))).first()
            seq = (known[0] or 0) + 1
            best = (known[1] is None or validation_loss < known[1]) if is_best is None else is_best
            entry = {
                "version": f"v{seq}", "seq": seq, "checkpoint_path": folder, "validation_loss": validation_loss, "creation_date": created_at,
                "is_best": best, "rank": model.rank, "threshold": threshold,
            }
            if files.write_new(self.spark, f"{self.path}/versions/{seq:08d}.json", json.dumps(entry)):
                return entry["version"]

    def load(self, requested: str = "latest") -> LoadedModel:
        """The model of a version, or of the pointers ``latest`` and ``best``."""
        registry = self.registry()
        wanted = self.spark.createDataFrame([(requested,)], "requested string")
        found = rg.resolve(wanted, registry).join(registry.select("version", "threshold"), "version", "left").first()
        if found["untrained"] or not files.exists(self.spark, found["checkpoint_path"]):
            return LoadedModel(None, untrained_model(), None)
        row = self.spark.read.schema(WEIGHTS).parquet(found["checkpoint_path"]).first()
        width = len(row["mean"])
        directions = np.array(row["directions"], float).reshape(-1, width).T
        return LoadedModel(found["version"], SubspaceModel(np.array(row["mean"]), directions, list(row["explained"])), found["threshold"])
