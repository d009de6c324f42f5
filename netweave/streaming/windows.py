"""Training windows that are requested while packets stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators.featurize import label_training


@dataclass
class WindowLabeller:
    """``foreachBatch`` function that labels packets with the windows known when their micro-batch begins.

    The folder of windows (start, end, and the ``group`` columns) is listed anew each time, so windows of any number that
    came meanwhile count, in the same way as in batch. A repeated batch overwrites itself.
    """

    windows: str
    output: str
    group: list[str] = field(default_factory=list)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        windows = batch.sparkSession.read.parquet(self.windows)
        labelled = label_training(batch.withColumn("ts", F.col("ts").cast("timestamp")), windows, self.group)
        labelled.write.mode("overwrite").parquet(f"{self.output}/batch={batch_id}")
