"""A topic written by a stream, each micro-batch once, with a log of what was delivered.

The records of batch N are in ``records/batch=N``; its entry in ``deliveries`` is created after them and by one writer only.
A batch with an entry is delivered: it is not written again, and only such batches are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.schemas import TOPIC
from netweave.sources import files

DELIVERY = "batch long, records long, keys_hash long, first_record_ts timestamp, last_record_ts timestamp"


@dataclass(frozen=True)
class TopicWriter:
    """``foreachBatch`` function for keyed records (key, value, record_ts)."""

    path: str

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = f"{self.path}/deliveries/{batch_id:012d}.json"
        if files.exists(spark, entry):
            return
        target = f"{self.path}/records/batch={batch_id}"
        batch.select(*TOPIC.fieldNames()).write.mode("overwrite").parquet(target)
        written = spark.read.schema(TOPIC).parquet(target)
        found = written.agg(
            F.count("*").alias("records"),
            F.coalesce(F.bit_xor(F.xxhash64("key", "value")), F.lit(0)).alias("keys_hash"),
            F.date_format(F.min("record_ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("first_record_ts"),
            F.date_format(F.max("record_ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("last_record_ts"),
        ).first()
        files.write_new(spark, entry, json.dumps({"batch": batch_id, **found.asDict()}))

    def deliveries(self, spark: SparkSession) -> DataFrame:
        """One row per delivered batch."""
        if not files.names(spark, f"{self.path}/deliveries"):
            return spark.createDataFrame([], DELIVERY)
        return spark.read.schema(DELIVERY).option("pathGlobFilter", "*.json").json(f"{self.path}/deliveries")

    def read(self, spark: SparkSession) -> DataFrame:
        """The records of delivered batches."""
        if not files.names(spark, f"{self.path}/records"):
            return spark.createDataFrame([], TOPIC)
        records = spark.read.schema(f"{_ddl()}, batch long").option("basePath", f"{self.path}/records").parquet(f"{self.path}/records")
        return records.join(self.deliveries(spark).select("batch"), "batch", "left_semi").select(*TOPIC.fieldNames())


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TOPIC.fields)
