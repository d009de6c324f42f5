"""The document store, one document per id, merged when it is written.

Ids are dealt to buckets by hash. A micro-batch reads the buckets its ids fall into, keeps the newest document of each id,
and replaces those buckets in one commit. A read is a plain scan: no id stands twice, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.sources.buckets import BUCKET, BUCKETS, BucketedTable
from netweave.sources.sinks import latest_per_id


@dataclass(frozen=True)
class DocumentStore:
    """``foreachBatch`` function; ``schema`` needs ``_id``, ``timestamp`` and ``stage_rank``.

    A document whose time and stage are those of the stored one leaves the stored one alone, so a repeated batch
    changes nothing; a null id is an id like others.
    """

    path: str
    schema: T.StructType
    buckets: int = BUCKETS
    spread: int = 1

    @property
    def table(self) -> BucketedTable:
        return BucketedTable(self.path, "_id", self.schema, self.buckets, self.spread)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, names = batch.sparkSession, self.schema.fieldNames()
        fresh = latest_per_id(batch.select(*names)).select(*names).persist()
        try:
            touched = self.table.touched(fresh)
            stored = self.table.read(spark, touched, before=batch_id)
            rows = stored.withColumn("_kept", F.lit(1)).unionByName(fresh.withColumn("_kept", F.lit(0)))
            # dealt by bucket once: the aggregate and the writer both keep that
            dealt = rows.withColumns({BUCKET: self.table.bucket(), "_share": self.table.share()}).repartition(BUCKET, "_share")
            newest = F.max_by(F.struct(*[n for n in names if n != "_id"]), F.struct("timestamp", "stage_rank", "_kept"))
            merged = dealt.groupBy(BUCKET, "_share", "_id").agg(newest.alias("d")).select(BUCKET, "_id", "d.*").select(*names, BUCKET)
            self.table.replace(merged, batch_id, touched)
        finally:
            fresh.unpersist()

    def read(self, spark: SparkSession) -> DataFrame:
        return self.table.read(spark)
