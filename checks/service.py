"""The service around the operators: trained and saved models, the merged store, sequences with kept state."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sequences as whole
from checks import views as v
from checks.catalog import query, r6, s6, work_folder
from checks.scoring import settled_sequences
from checks.sequences import KEYS
from netweave.operators import detectors, featurize
from netweave.operators import serving as sv
from netweave.operators import training as tr
from netweave.session import settled
from netweave.sources import sinks
from netweave.sources.deliveries import TopicWriter
from netweave.sources.models import ModelStore
from netweave.sources.store import DocumentStore
from netweave.sources.tables import packets, predictions, raw_messages, stage_log
from netweave.streaming.sequencer import MicroBatchSequencer

RANK_ZERO = tr.TrainingRule(max_rank=0)
CREATED = "2024-02-01T00:00:00Z"

TRAINED = f"""{v.SCALED},
ids as (select sensor_id, epoch, seq_no, sha256(concat_ws('|', sensor_id, cast(epoch as varchar), cast(seq_no as varchar))) as _id
  from scaled where is_training group by 1, 2, 3),
parted as (select *, row_number() over (order by _id) <= floor(count(*) over () * 0.8e0) as is_train from ids),
rank0 as (select s.pos, {", ".join(f"avg(s.{f}) as {f}" for f in v.FEATURES)} from scaled s
  join parted p on s.sensor_id = p.sensor_id and s.epoch = p.epoch and s.seq_no = p.seq_no where p.is_train group by s.pos),
all_errors as (select s.sensor_id, s.epoch, s.seq_no, sum({v.ERROR_SUM}) / 192.0e0 as err from scaled s join rank0 m on s.pos = m.pos group by 1, 2, 3),
validated as (select p._id, e.err, (row_number() over (order by p._id) - 1) // 32 as batch_no, row_number() over (order by e.err, p._id) as r, count(*) over () as n
  from parted p join all_errors e on e.sensor_id = p.sensor_id and e.epoch = p.epoch and e.seq_no = p.seq_no where not p.is_train),
loss as (select avg(l) as loss from (select avg(err) as l from validated group by batch_no)),
limits as (select err as threshold from validated where r = floor(n * 0.9e0) + 1)"""


@query(
    "trained_model",
    "D6, D7, D4, D12, D16, D20",
    v.sql(TRAINED, f"select 'v1' as version, cast(0 as int) as rank, {s6('loss')} as loss, {s6('threshold')} as threshold, true as is_best from loss, limits"),
)
def trained_model(spark, folder):
    store = ModelStore(spark, work_folder(spark, "models"))
    tr.train_and_save(settled_sequences(spark, folder).filter("is_training"), store, CREATED, RANK_ZERO)
    found = store.registry()
    return found.select("version", "rank", r6(F.col("validation_loss")).alias("loss"), r6(F.col("threshold")).alias("threshold"), "is_best")


@query(
    "scored_by_version",
    "D9, D17, D12",
    v.sql(
        TRAINED,
        f"""select sensor_id, epoch, seq_no, 'v1' as model_version, {s6('err')} as reconstruction_error,
          err >= (select threshold from limits) - 1e-9 as is_anomaly from all_errors""",
    ),
)
def scored_by_version(spark, folder):
    """Saved, resolved by the pointer to the best, loaded, and used with its own threshold."""
    store = ModelStore(spark, work_folder(spark, "models"))
    rows = settled_sequences(spark, folder)
    _, trained = tr.train_and_save(rows.filter("is_training"), store, CREATED, RANK_ZERO)
    scored = tr.score_by_version(rows, store, threshold=trained.threshold - 1e-9)
    return scored.select(*KEYS, "model_version", r6(F.col("reconstruction_error")).alias("reconstruction_error"), "is_anomaly")


@query(
    "higher_rank_gain",
    "D6, D20, U1, F14",
    v.sql(TRAINED, "select true as no_worse_than_rank_zero, true as falls_with_rank"),
)
def higher_rank_gain(spark, folder):
    """On the training sequences each further direction leaves less; the best rank loses no more than rank 0."""
    rows = settled_sequences(spark, folder).filter("is_training")
    trained = tr.train(rows, tr.TrainingRule(max_rank=6))
    model = tr.sc.fit_directions(rows, 6)
    rest = rows.select(model.prefix_scorer()(F.flatten("sequence")).alias("errors"))
    means = [F.avg(F.get("errors", F.lit(k))) for k in (0, 6)]
    return rest.agg((means[1] <= means[0]).alias("falls_with_rank")).withColumn(
        "no_worse_than_rank_zero", F.lit(trained.validation_loss <= trained.history[0][1])
    )


NEWEST = """newest as (select *, row_number() over (partition by _id order by timestamp desc, stage_rank desc) as r from stage_log)"""
CUTS = ["2024-01-06", "2024-01-17"]


def in_batches(rows, column):
    """The rows in three stretches of time, as a stream would bring them."""
    at = F.col(column)
    bounds = [F.lit(c).cast("timestamp").cast(rows.schema[column].dataType) for c in CUTS]
    return [rows.filter(at < bounds[0]), rows.filter((at >= bounds[0]) & (at < bounds[1])), rows.filter(at >= bounds[1])]


@query(
    "merged_store",
    "A10, T6, G5",
    v.sql(
        v.STAGE_LOG + ",\n" + NEWEST,
        f"select _id, stage, timestamp, {s6('reconstruction_error')} as reconstruction_error from newest where r = 1",
    ),
)
def merged_store(spark, folder):
    rows = stage_log(spark, folder)
    store = DocumentStore(work_folder(spark, "store"), rows.schema, buckets=8)
    for number, batch in enumerate(in_batches(rows, "timestamp")):
        store(batch, number)
    store(batch, number)
    return store.read(spark).select("_id", "stage", "timestamp", r6(F.col("reconstruction_error")).alias("reconstruction_error"))


@query("streamed_sequences", "T1, U3, C1-C7", v.sql(v.SCALED, whole.SCALED_BODY))
def streamed_sequences(spark, folder):
    """Three micro-batches with nothing between them but the state; the last one comes twice."""
    target = work_folder(spark, "sequences")
    handler = MicroBatchSequencer(f"{target}/out", f"{target}/state", whole.RULE, buckets=8)
    rows = whole.labelled(spark, folder)
    rows = settled(rows.withColumn("ts", F.col("ts").cast("timestamp")), "labelled")  # made once for the four batches
    for number, batch in enumerate(in_batches(rows, "ts")):
        handler(batch, number)
    handler(batch, number)
    return whole.exploded(spark.read.parquet(f"{target}/out").drop("batch"))


PAGE_CTES = v.PREDICTIONS + ",\nplaced as (select _id, timestamp, row_number() over (order by timestamp, _id) as place from predictions)"


@query("deep_page", "G1, G2", v.sql(PAGE_CTES, "select _id, timestamp, place from placed where place > 9000 and place <= 9100"))
def deep_page(spark, folder):
    """Page 91 of 100 rows each, with small pieces: only the pieces that hold it are sorted."""
    rows = predictions(spark, folder).select("_id", "timestamp")
    return sv.deep_page(rows, 91, 100, rows_per_split=700)


@query(
    "merged_pair_sketches",
    "E7",
    v.sql(
        v.PACKETS,
        """select sensor_id, count(distinct concat(src_ip, '|', dst_ip)) as pairs, count(*) as packets, true as within_bound
           from packets where proto is not null group by sensor_id""",
    ),
)
def merged_pair_sketches(spark, folder):
    """Sketches per day, written and read again, then merged; four standard errors from the exact count at most."""
    rows = featurize.only_ip(packets(spark, folder))
    path = work_folder(spark, "sketches")
    detectors.pair_sketches(rows, "1 day", ["sensor_id"]).write.parquet(path)
    merged = detectors.merged_pairs(spark.read.parquet(path), ["sensor_id"]).withColumnRenamed("pairs", "about")
    exact = rows.groupBy("sensor_id").agg(F.count_distinct(F.concat_ws("|", "src_ip", "dst_ip")).alias("pairs"))
    within = F.abs(F.col("about") - F.col("pairs")) <= 1 + 0.026 * F.col("pairs")
    return merged.join(exact, "sensor_id").select("sensor_id", "pairs", "packets", within.alias("within_bound"))


@query(
    "delivered_topic",
    "A8, T2",
    v.sql(v.MESSAGES, "select msg_key as key, value, record_ts from raw_messages"),
)
def delivered_topic(spark, folder):
    """Messages in three micro-batches, of which two come twice."""
    log = raw_messages(spark, folder)
    rows = log.select(F.col("msg_key").alias("key"), "value", F.col("record_ts").cast("timestamp").alias("record_ts"))
    writer = TopicWriter(work_folder(spark, "topic"))
    batches = in_batches(rows, "record_ts")
    for number in (0, 1, 1, 2, 0):
        writer(batches[number], number)
    return writer.read(spark).withColumn("record_ts", F.col("record_ts").cast("timestamp_ntz"))


@query(
    "pretty_document_fields",
    "F11",
    v.sql(
        v.PREDICTIONS,
        f"select _id, printf('%.4f', reconstruction_error) as error, {s6('familiarity')} as familiarity, is_anomaly, timestamp from anomalies",
    ),
)
def pretty_document_fields(spark, folder):
    """The pretty text parsed again gives the document's fields."""
    rows = predictions(spark, folder).filter("is_anomaly").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    fields = F.from_json("document", "familiarity double, is_anomaly boolean, timestamp timestamp")
    cards = sv.document_cards(rows).select("_id", "error", fields.alias("d"), "document").filter(F.instr("document", "\n") > 0)
    return cards.select("_id", "error", r6(F.col("d.familiarity")).alias("familiarity"), "d.is_anomaly", F.col("d.timestamp").cast("timestamp_ntz").alias("timestamp"))


RANGE = ("2024-01-05 06:00:00", "2024-01-12 00:00:00")


@query(
    "stored_time_range",
    "A14, B20",
    v.sql(v.PREDICTIONS, f"select _id, timestamp from predictions where timestamp >= timestamp '{RANGE[0]}' and timestamp <= timestamp '{RANGE[1]}'"),
)
def stored_time_range(spark, folder):
    """Documents in day folders, each file a stretch of time; a range reads the days it touches."""
    path = work_folder(spark, "collection")
    sinks.write_collection(predictions(spark, folder), path)
    start, end = (F.lit(t).cast("timestamp_ntz") for t in RANGE)
    return sinks.read_collection(spark, path, start, end).select("_id", "timestamp")


@query(
    "exported_training_set",
    "A16",
    v.sql(v.SCALED, f"select sensor_id, epoch, seq_no, pos, {whole.cells('')} from scaled where is_training"),
)
def exported_training_set(spark, folder):
    path = work_folder(spark, "training-set")
    sinks.export_training_set(settled_sequences(spark, folder), path)
    return whole.exploded(spark.read.parquet(path))
