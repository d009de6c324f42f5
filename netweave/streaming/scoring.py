"""The scoring service on a stream: each micro-batch asks the model store which version is the one to use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.operators import quality as ql
from netweave.operators import scoring as sc
from netweave.schemas import ANOMALY_THRESHOLD
from netweave.sources.models import ModelStore
from netweave.sources.topics import to_topic


@dataclass
class ScoringStage:
    """``foreachBatch`` function from processed records to predictions and rejects.

    ``version`` is ``latest``, ``best`` or a name; it is looked up in every micro-batch, so a model saved meanwhile scores
    the next one. Without a trained model the untrained one scores. ``threshold`` None takes that of the model. Records
    that are refused, and valid ones without a score, are rejects with a reason. Folders carry the batch id, so a
    repeated batch overwrites itself.
    """

    models: ModelStore
    predictions: str
    rejects: str
    version: str = "best"
    threshold: float | None = ANOMALY_THRESHOLD
    scored_at: Column | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        loaded = self.models.load(self.version)
        own = loaded.threshold if loaded.threshold is not None else ANOMALY_THRESHOLD
        limit = own if self.threshold is None else self.threshold
        log = ql.checked(batch, ql.scoring_reason())
        error = sc.score_by_subspace(log.filter(F.col("reason").isNull()).withColumn("sequence", F.col("doc.sequence")), loaded.model)
        scored = error.drop("sequence").unionByName(log.filter(F.col("reason").isNotNull()), allowMissingColumns=True)
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            valid = scored.filter(F.col("reason").isNull())
            rows = ql.valid_messages(valid)  # a column of the log goes before the field of that name
            at = F.current_timestamp() if self.scored_at is None else self.scored_at
            predicted = sc.to_predictions(rows, at, limit).drop("key", "record_ts").withColumn("model_version", F.lit(loaded.version).cast("string"))
            to_topic(predicted).write.mode("overwrite").parquet(f"{self.predictions}/batch={batch_id}")
            refused = scored.filter(F.col("reason").isNotNull()).unionByName(sc.without_score(valid.drop("reason")), allowMissingColumns=True)
            refused.select("key", "value", "record_ts", "reason").write.mode("overwrite").parquet(f"{self.rejects}/batch={batch_id}")
        finally:
            scored.unpersist()
