"""Packet stream to scaled sequences, in arrival order, with incremental state per sensor.

Of a sensor's open epoch only what later packets need is kept: how many packets arrived, how many were usable, the fewer
than ``length`` packets of the unfinished sequence, the address pairs seen, and the scaler's parameters. The state is
a table in buckets of sensors: a micro-batch reads and replaces the buckets of its own sensors and leaves the others
alone. The packets of a batch go through the batch operators, partitioned by (sensor, epoch), so a busy sensor is not
one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.functions.features import has_all_fields
from netweave.operators import sequencing as sq
from netweave.plans.ordering import ordinals
from netweave.schemas import PACKET
from netweave.sources.buckets import BUCKETS, BucketedTable

LABELLED = T.StructType([*PACKET.fields, T.StructField("is_training", T.BooleanType())])
WAITING = T.StructType([*LABELLED.fields[:1], *LABELLED.fields[2:], T.StructField("arrival", T.LongType()), T.StructField("vi", T.LongType())])
PAIR = T.StructType([T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()), T.StructField("trained", T.BooleanType())])
PARAMS = T.ArrayType(T.StructType([T.StructField("median", T.DoubleType()), T.StructField("iqr", T.DoubleType())]))
STATE = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("arrived", T.LongType()),  # packets of the sensor so far
        T.StructField("usable", T.LongType()),  # usable ones of the open epoch
        T.StructField("waiting", T.ArrayType(WAITING)),  # of the unfinished sequence
        T.StructField("pairs", T.ArrayType(PAIR)),  # in finished sequences of the open epoch
        T.StructField("params", PARAMS),  # of the open epoch, once its first sequence is finished
    ]
)


@dataclass
class MicroBatchSequencer:
    """``foreachBatch`` function that appends finished sequences to ``output``.

    Output and state carry the batch id, so a repeated batch overwrites itself. A fresh checkpoint needs fresh
    folders: a state that is ahead of the batch id is refused.
    """

    output: str
    state: str
    rule: sq.SequenceRule
    buckets: int = BUCKETS

    @property
    def table(self) -> BucketedTable:
        return BucketedTable(self.state, "sensor_id", STATE, self.buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.table.expect(spark, batch_id)
        batch = batch.select(*LABELLED.fieldNames()).persist(StorageLevel.MEMORY_AND_DISK)
        kept = [batch]
        try:
            touched = self.table.touched(batch)
            state = self.table.read(spark, touched, before=batch_id).withColumn("epoch", F.floor(F.col("arrived") / self.rule.reset_every))
            arrived = _joined(ordinals(batch, self.rule.order, "n", ["sensor_id"], rows_per_split=self.rule.rows_per_split), state, ["arrived", "usable"])
            fresh = arrived.withColumn("arrival", F.col("n") + F.coalesce("_known_arrived", F.lit(0))).withColumn("epoch", sq.epoch_of(F.col("arrival"), self.rule))
            fresh = fresh.persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(fresh)
            rows = self._with_waiting(fresh, state).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(rows)
            marked = self._marked(rows.filter("finished"), state)
            sequences = self._sequences(marked, state).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(sequences)
            sq.scale_by_params(sequences).write.mode("overwrite").parquet(f"{self.output}/batch={batch_id}")
            self.table.replace(self._next_state(fresh, rows, marked, sequences, state), batch_id, touched)
        finally:
            for frame in kept:
                frame.unpersist()

    def _with_waiting(self, fresh: DataFrame, state: DataFrame) -> DataFrame:
        """Usable packets of the batch and those that waited, with their place in the epoch and whether their sequence is finished."""
        in_order = Window.partitionBy(*sq.EPOCH).orderBy("arrival")
        in_epoch = Window.partitionBy(*sq.EPOCH)
        earlier = F.when(F.col("epoch") == F.floor(F.coalesce("_known_arrived", F.lit(0)) / self.rule.reset_every), F.col("_known_usable"))
        columns = [*LABELLED.fieldNames(), "arrival", "epoch", "vi"]
        usable = (
            fresh.filter(has_all_fields())
            .repartition(*sq.EPOCH)
            .withColumn("vi", F.row_number().over(in_order) - 1 + F.coalesce(earlier, F.lit(0)))
            .select(*columns)
        )
        waiting = state.select("sensor_id", "epoch", F.inline("waiting")).select(*columns)
        both = usable.unionByName(waiting).repartition(*sq.EPOCH).withColumn("_last", F.max("vi").over(in_epoch))
        return (
            both.withColumn("seq_no", F.floor(F.col("vi") / self.rule.length).cast("long"))
            .withColumn("pos", (F.col("vi") % self.rule.length).cast("int"))
            .withColumn("finished", F.col("seq_no") < F.floor((F.col("_last") + 1) / self.rule.length))
            .drop("_last")
        )

    def _marked(self, placed: DataFrame, state: DataFrame) -> DataFrame:
        """New pairs of finished sequences: first ones here that the epoch had not shown in earlier batches."""
        known = state.select("sensor_id", "epoch", F.inline("pairs")).select(*[F.col(c).alias(f"_known_{c}") for c in (*sq.EPOCH, "src_ip", "dst_ip", "trained")])
        same = F.lit(True)
        for name in (*sq.EPOCH, "src_ip", "dst_ip"):
            same = same & F.col(name).eqNullSafe(F.col(f"_known_{name}"))
        met = sq.mark_new_pairs(placed).join(known, same, "left")
        return met.withColumns(
            {
                "new_pair": F.when(F.col("_known_trained").isNull(), F.col("new_pair")).otherwise(0),
                "new_trained": F.when(F.coalesce("_known_trained", F.lit(False)), 0).otherwise(F.col("new_trained")),
            }
        ).select(*placed.columns, "new_pair", "new_trained")

    def _sequences(self, marked: DataFrame, state: DataFrame) -> DataFrame:
        """Finished sequences with the parameters of their epoch, whether from this batch or an earlier one."""
        trained = F.size(F.filter("pairs", lambda p: p["trained"]))
        before = state.select(*sq.EPOCH, F.size("pairs").alias("_seen_before"), trained.alias("_trained_before"))
        sequences = sq.with_first_params(sq.assemble_marked(marked, self.rule, before), self.rule)
        known = _joined(sequences, state.filter("params is not null"), ["params"], sq.EPOCH)
        return known.withColumn("_params", F.coalesce("_params", "_known_params")).drop("_known_params")

    def _next_state(self, fresh: DataFrame, rows: DataFrame, marked: DataFrame, sequences: DataFrame, state: DataFrame) -> DataFrame:
        """One row per sensor, from facts about its epochs; the open epoch has fewer than ``reset_every`` of them."""
        last = fresh.groupBy("sensor_id").agg(F.max("arrival").alias("arrived"))
        facts = [("arrived", T.LongType()), ("usable", T.LongType()), ("packet", WAITING), ("pair", PAIR), ("params", PARAMS)]

        def fact(frame: DataFrame, **columns: Column) -> DataFrame:
            values = [columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in facts]
            return frame.select("sensor_id", "epoch", *values)

        shown = state.select("sensor_id", "epoch", F.inline("pairs")).unionByName(
            marked.filter("new_pair = 1 or new_trained = 1").select("sensor_id", "epoch", "src_ip", "dst_ip", (F.col("new_trained") == 1).alias("trained"))
        )
        pairs = shown.groupBy(*sq.EPOCH, "src_ip", "dst_ip").agg(F.bool_or("trained").alias("trained"))
        sides = [
            fact(last.withColumn("epoch", F.floor(F.col("arrived") / self.rule.reset_every)), arrived=F.col("arrived")),
            fact(rows, usable=F.col("vi") + 1, packet=F.when(~F.col("finished"), F.struct(*WAITING.fieldNames()))),
            fact(pairs, pair=F.struct("src_ip", "dst_ip", "trained")),
            fact(sequences.filter("seq_no = 0"), params=F.col("_params")),
            fact(state, usable=F.col("usable"), params=F.col("params")),
        ]
        every = reduce(DataFrame.unionByName, sides)
        still_open = F.col("epoch") == F.floor(F.col("_known_arrived") / self.rule.reset_every)
        renewed = _joined(every, last, ["arrived"]).filter(still_open).groupBy("sensor_id").agg(
            F.max("arrived").alias("arrived"),
            F.coalesce(F.max("usable"), F.lit(0)).alias("usable"),
            F.collect_list("packet").alias("waiting"),
            F.collect_list("pair").alias("pairs"),
            F.first("params", ignorenulls=True).alias("params"),
        )
        others = state.join(last.select(F.col("sensor_id").alias("_sensor")), F.col("sensor_id").eqNullSafe(F.col("_sensor")), "left_anti")
        return renewed.unionByName(others.select(*STATE.fieldNames()))


def _joined(left: DataFrame, right: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """``left`` with columns of ``right`` as ``_known_...``; null keys meet each other."""
    keys = keys or ["sensor_id"]
    side = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(c).alias(f"_known_{c}") for c in columns])
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    return left.join(side, same, "left").drop(*[f"_key_{k}" for k in keys])
