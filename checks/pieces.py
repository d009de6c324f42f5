"""Ordered queries once more with small pieces, the way large tables take, against the same SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import sequences as whole
from checks import views as v
from checks.catalog import ENTRIES, query, r6
from checks.scoring import embedding_errors
from netweave.operators import scoring as sc
from netweave.operators import sequencing as sq
from netweave.operators import serving as sv
from netweave.plans.ordering import Total, running
from netweave.session import settled
from netweave.sources.tables import packets, predictions, table, training_metrics

ROWS_PER_PIECE = 300
RULE = replace(whole.RULE, rows_per_split=ROWS_PER_PIECE)


def in_pieces(name: str):
    return query(f"{name}_in_pieces", ENTRIES[name].covers, ENTRIES[name].sql)


@in_pieces("buffer_epochs")
def buffer_epochs(spark, folder):
    return sq.number_epochs(packets(spark, folder), RULE).select("packet_id", "sensor_id", "arrival", "epoch")


@in_pieces("bounded_history")
def bounded_history(spark, folder):
    return sq.newest_packets(packets(spark, folder), 1000, RULE).select("packet_id", "sensor_id", "rank")


@in_pieces("latest_sequence")
def latest_sequence(spark, folder):
    found = sq.latest_sequence(packets(spark, folder), RULE, F.col("packet_id").cast("string"))
    return found.select("sensor_id", F.array_join("sequence", ",").alias("packet_ids"))


@in_pieces("running_counters")
def running_counters(spark, folder):
    return sv.running_counts(predictions(spark, folder), ROWS_PER_PIECE).select("_id", "total", "normal", "anomalous")


@in_pieces("dynamic_threshold")
def dynamic_threshold(spark, folder):
    found = sc.dynamic_threshold(predictions(spark, folder), rows_per_split=ROWS_PER_PIECE)
    return found.select(r6(F.col("threshold")).alias("threshold"))


@in_pieces("sliding_sequences")
def sliding_sequences(spark, folder):
    return whole.sliding_sequences(spark, folder, RULE)


@in_pieces("batch_losses")
def batch_losses(spark, folder):
    found = sc.batch_losses(embedding_errors(spark, folder), ["vec_id"], rows_per_split=ROWS_PER_PIECE)
    return found.withColumn("loss", r6(F.col("loss")))


@in_pieces("train_validation_split")
def train_validation_split(spark, folder):
    return sc.split_exact(predictions(spark, folder), ["timestamp", "_id"], rows_per_split=ROWS_PER_PIECE).select("_id", "is_train")


@in_pieces("early_stopping")
def early_stopping(spark, folder):
    found = sc.early_stopping(training_metrics(spark, folder), rows_per_split=ROWS_PER_PIECE)
    return found.withColumn("best_loss", r6(F.col("best_loss")))


@in_pieces("flagged_sequences")
def flagged_sequences(spark, folder):
    rows = settled(sq.build_sequences(whole.labelled(spark, folder), RULE).select("_id", *whole.KEYS, "is_training", "sequence"), "sequences")
    scored = sc.score_by_mean(rows, sc.mean_model(rows.filter("is_training")))
    error = F.col("reconstruction_error")
    return scored.select(*whole.KEYS, "is_training", r6(error).alias("reconstruction_error"), sc.flag(error).alias("is_anomaly"))


NULLED = """nulled as (
  select event_id, case when user_id % 3 = 0 then null else user_id % 4 end as g, case when event_id % 7 = 0 then null else value end as x from events)"""


@query(
    "running_totals_with_nulls_in_pieces",
    "C2, E2, D15",
    v.sql(
        NULLED,
        """select event_id, count(*) over w as place, count(x) over w as known, min(x) over w as least
           from nulled window w as (partition by g order by x nulls first, event_id rows unbounded preceding)""",
    ),
)
def running_totals_with_nulls(spark, folder):
    """Null groups, null keys and null values, with the names that the pieces use as columns of the table."""
    x = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    rows = table(spark, folder, "events").select(
        "event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 4).alias("g"), x.alias("x"), F.lit("own").alias("_split"), F.lit("own").alias("_group")
    )
    one = F.lit(1).cast("long")
    totals = {"place": Total("sum", one), "known": Total("sum", F.col("x").isNotNull().cast("long")), "least": Total("min", F.col("x"))}
    found = running(rows, ["x", "event_id"], totals, ["g"], rows_per_split=ROWS_PER_PIECE)
    return found.filter("_split = 'own' and _group = 'own'").select("event_id", "place", "known", "least")
