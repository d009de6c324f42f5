"""Topic messages: reading, checking, routing and storing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.catalog import query, r6, s6
from netweave.functions import text as tx
from netweave.operators import quality as ql
from netweave.operators import serving as sv
from netweave.schemas import RAW_KEYS, SCORING_KEYS
from netweave.sources import sinks, topics
from netweave.sources.tables import feedback, predictions, raw_messages, stage_log

KEYS_OK = v.has_keys_sql(RAW_KEYS)
SCORING_OK = v.has_keys_sql(SCORING_KEYS)
SEQ = "cast(json_array_length(value, '$.sequence') as bigint)"
HUMAN = "cast(json_array_length(value, '$.human_readable') as bigint)"
FAMILIARITY = s6("cast(value->>'$.familiarity' as double)")
REASON = f"""case when not json_valid(value) then 'malformed' when not {KEYS_OK} then 'missing_key'
  when {SEQ} <> 16 then 'sequence_length' when {SEQ} <> {HUMAN} then 'parallel_length' end"""
SCORING_REASON = f"""case when not json_valid(value) then 'malformed' when not {SCORING_OK} then 'missing_key'
  when {SEQ} <> 16 then 'sequence_length'
  when list_aggregate([json_array_length(value, concat('$.sequence[', cast(i as varchar), ']')) for i in range(16)], 'min') <> 12
    or list_aggregate([json_array_length(value, concat('$.sequence[', cast(i as varchar), ']')) for i in range(16)], 'max') <> 12 then 'batch_shape' end"""
JUDGED = f"{v.MESSAGES},\njudged as (select *, {REASON} as reason from raw_messages)"
TRAINING = "cast(value->>'$.is_training' as boolean)"
RECORD_TIME = "2024-02-01 00:00:00"


def judged(spark, folder):
    return ql.checked(raw_messages(spark, folder), ql.raw_reason())


def valid(spark, folder):
    return ql.valid_messages(judged(spark, folder))


@query(
    "training_topic_read",
    "A6, F2",
    v.sql(
        v.MESSAGES,
        f"select offset_no, value->>'$._id' as _id, {TRAINING} as is_training, {FAMILIARITY} as familiarity, {SEQ} as packets from raw_messages where json_valid(value)",
    ),
)
def training_topic_read(spark, folder):
    rows = ql.readable_messages(raw_messages(spark, folder))
    return rows.select(
        "offset_no", "_id", "is_training", r6(F.col("familiarity")).alias("familiarity"), F.size("sequence").cast("long").alias("packets")
    )


ANOMALY_MARKS = v.PREDICTIONS + "," + v.FEEDBACK
LABELED = """
marks as (select _id, min(marked_at) as marked_at from feedback where _id is not null group by _id),
labeled as (select a._id, m.marked_at as timestamp, false as is_anomaly, true as is_false_positive, false as is_training,
  a.reconstruction_error, a.familiarity from anomalies a join marks m on a._id = m._id)"""
LABELED_FIELDS = f"_id, timestamp, is_anomaly, is_false_positive, is_training, {s6('reconstruction_error')} as reconstruction_error, {s6('familiarity')} as familiarity"


def labelled_topic(spark, folder):
    anomalies = predictions(spark, folder).filter("is_anomaly")
    return sv.labeled_records(anomalies, feedback(spark, folder))


@query("labeled_topic_read", "A7, A8", v.sql(ANOMALY_MARKS + "," + LABELED, f"select {LABELED_FIELDS} from labeled"))
def labeled_topic_read(spark, folder):
    """Labelled records written as keyed JSON and read back."""
    written = topics.to_topic(labelled_topic(spark, folder))
    rows = ql.readable_messages(written)
    return rows.select(
        F.col("key").alias("_id"),
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "is_anomaly",
        "is_false_positive",
        "is_training",
        r6(F.col("reconstruction_error")).alias("reconstruction_error"),
        r6(F.col("familiarity")).alias("familiarity"),
    )


@query(
    "stage_router",
    "A9",
    v.sql(
        JUDGED,
        f"""select offset_no, value->>'$._id' as _id, 'processed' as topic from judged where reason is null
        union all select offset_no, value->>'$._id', 'training' from judged where reason is null and {TRAINING}""",
    ),
)
def stage_router(spark, folder):
    return topics.route(valid(spark, folder)).select("offset_no", "_id", "topic")


STORED = "processed training predictions labeled".split()


def stages(spark, folder):
    log = stage_log(spark, folder)
    return [log.filter(F.col("stage") == s) for s in STORED]


STORE_SQL = "store as (select * from stage_log where stage in ('processed', 'training', 'predictions', 'labeled'))"


@query(
    "collection_latest_per_id",
    "A10, G5",
    v.sql(
        v.STAGE_LOG + ",\n" + STORE_SQL,
        f"""select _id, stage, stage_rank, timestamp, {s6('reconstruction_error')} as reconstruction_error from (
          select *, row_number() over (partition by _id order by timestamp desc, stage_rank desc) as r from store) where r = 1""",
    ),
)
def collection_latest_per_id(spark, folder):
    rows = sinks.collection(stages(spark, folder), "upsert")
    return rows.withColumn("reconstruction_error", r6(F.col("reconstruction_error")))


@query("collection_append", "A10, S1", v.sql(v.STAGE_LOG + ",\n" + STORE_SQL, "select _id, stage, timestamp from store"))
def collection_append(spark, folder):
    return sinks.collection(stages(spark, folder), "append").select("_id", "stage", "timestamp")


@query(
    "sink_field_transforms",
    "A11",
    v.sql(v.MESSAGES, f"select offset_no, record_ts as timestamp, coalesce({TRAINING}, false) as is_training from raw_messages where json_valid(value)"),
)
def sink_field_transforms(spark, folder):
    rows = sinks.sink_fields(ql.readable_messages(raw_messages(spark, folder)))
    return rows.select("offset_no", "timestamp", "is_training")


@query("error_tolerant_sink", "A12", v.sql(v.MESSAGES, "select offset_no, json_valid(value) as accepted, case when json_valid(value) then value->>'$._id' end as _id from raw_messages"))
def error_tolerant_sink(spark, folder):
    rows = sinks.tolerant(raw_messages(spark, folder))
    return rows.select("offset_no", "accepted", F.when(F.col("accepted"), F.col("doc._id")).alias("_id"))


DOCUMENT = f"""documents_text as (select event_id, concat('{{"timestamp":', case when {v.K} % 7 = 0 then '5' when {v.K} % 7 = 1 then '"soon"' else '"2024-01-01T00:00:00.000"' end,
  ',"sequence":', case when {v.K} % 5 = 0 then 'null' when {v.K} % 5 = 1 then '"text"' else '[[0.1]]' end,
  case when {v.K} % 3 = 0 then '' else concat(',"is_training":', case when {v.K} % 3 = 1 then 'true' else '"yes"' end) end,
  ',"reconstruction_error":', case when {v.K} % 11 = 0 then '"high"' when {v.K} % 11 = 1 then 'null' else '0.25' end, ',"other":[1]}}') as value from events)"""


@query(
    "typed_document_validator",
    "A13",
    v.sql(
        DOCUMENT,
        """select event_id, concat_ws(',',
          case when json_type(value, '$.timestamp') <> 'VARCHAR' or try_cast(value->>'$.timestamp' as timestamp) is null then 'timestamp' end,
          case when json_type(value, '$.sequence') not in ('ARRAY', 'NULL') then 'sequence' end,
          case when json_type(value, '$.is_training') not in ('BOOLEAN', 'NULL') then 'is_training' end,
          case when json_type(value, '$.reconstruction_error') not in ('DOUBLE', 'UBIGINT', 'BIGINT', 'NULL') then 'reconstruction_error' end) as wrong_fields
        from documents_text""",
    ),
)
def typed_document_validator(spark, folder):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    from netweave.sources.tables import table

    value = F.concat(
        F.lit('{"timestamp":'),
        F.when(k % 7 == 0, "5").when(k % 7 == 1, '"soon"').otherwise('"2024-01-01T00:00:00.000"'),
        F.lit(',"sequence":'),
        F.when(k % 5 == 0, "null").when(k % 5 == 1, '"text"').otherwise("[[0.1]]"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, ',"is_training":true').otherwise(',"is_training":"yes"'),
        F.lit(',"reconstruction_error":'),
        F.when(k % 11 == 0, '"high"').when(k % 11 == 1, "null").otherwise("0.25"),
        F.lit(',"other":[1]}'),
    )
    rows = table(spark, folder, "events").select("event_id", value.alias("value"))
    return rows.select("event_id", F.array_join(ql.typed_violations(F.col("value")), ",").alias("wrong_fields"))


@query("topic_retention", "A15", v.sql(v.MESSAGES, "select offset_no, record_ts from raw_messages where record_ts >= timestamp '2024-01-15 12:00:00' - interval 1 hour"))
def topic_retention(spark, folder):
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return sinks.within_retention(raw_messages(spark, folder), as_of).select("offset_no", "record_ts")


@query("required_raw_keys", "B12", v.sql(v.MESSAGES, f"select offset_no, case when json_valid(value) then {KEYS_OK} else false end as complete from raw_messages"))
def required_raw_keys(spark, folder):
    return raw_messages(spark, folder).select("offset_no", ql.has_keys(F.col("value"), RAW_KEYS).alias("complete"))


@query("required_scoring_keys", "B13", v.sql(v.MESSAGES, f"select offset_no, case when json_valid(value) then {SCORING_OK} else false end as complete from raw_messages"))
def required_scoring_keys(spark, folder):
    return raw_messages(spark, folder).select("offset_no", ql.has_keys(F.col("value"), SCORING_KEYS).alias("complete"))


def shape_query(name, covers, condition, sql_condition):
    @query(name, covers, v.sql(v.MESSAGES, f"select offset_no, coalesce({sql_condition}, false) as fits from raw_messages where json_valid(value)"))
    def run(spark, folder):
        rows = ql.readable_messages(raw_messages(spark, folder))
        return rows.select("offset_no", condition().alias("fits"))

    return run


WIDTHS = "[json_array_length(value, concat('$.sequence[', cast(i as varchar), ']')) for i in range(16)]"
shape_query("sequence_length_check", "B14", lambda: ql.right_length(F.col("sequence")), f"{SEQ} = 16")
shape_query("parallel_length_check", "B15", lambda: ql.parallel(F.col("sequence"), F.col("human_readable")), f"{SEQ} = {HUMAN}")
shape_query("sample_shape_check", "B16", lambda: ql.sample_shape(F.col("sequence")), f"{SEQ} = 16 and json_array_length(value, '$.sequence[0]') = 12")
shape_query(
    "batch_shape_check",
    "B17",
    lambda: ql.batch_shape(F.col("sequence")),
    f"{SEQ} = 16 and list_min({WIDTHS}) = 12 and list_max({WIDTHS}) = 12",
)


@query(
    "verdict_defaults",
    "B18",
    v.sql(
        JUDGED,
        f"""select offset_no, value->>'$._id' as _id, timestamp '{RECORD_TIME}' as timestamp, false as is_anomaly, false as is_false_positive,
          cast(null as double) as reconstruction_error, {TRAINING} as is_training, {FAMILIARITY} as familiarity
        from judged where reason is null""",
    ),
)
def verdict_defaults(spark, folder):
    rows = ql.reset_defaults(valid(spark, folder), F.lit(RECORD_TIME).cast("timestamp_ntz"))
    return rows.select(
        "offset_no", "_id", "timestamp", "is_anomaly", "is_false_positive", "reconstruction_error", "is_training", r6(F.col("familiarity")).alias("familiarity")
    )


@query(
    "training_matrices",
    "B19",
    v.sql(JUDGED, f"select value->>'$._id' as _id, {SEQ} as packets, cast(json_array_length(value, '$.sequence[0]') as bigint) as width from judged where reason is null and {TRAINING}"),
)
def training_matrices(spark, folder):
    rows = ql.training_matrices(valid(spark, folder).filter("is_training"))
    width = F.size(F.get("sequence", F.lit(0))).cast("long")
    return rows.select("_id", F.size("sequence").cast("long").alias("packets"), width.alias("width"))


@query("malformed_messages", "B24", v.sql(v.MESSAGES, "select offset_no, 'raw' as source, 'malformed' as reason, value from raw_messages where not json_valid(value)"))
def malformed_messages(spark, folder):
    log = judged(spark, folder).filter(F.col("reason") == "malformed")
    return log.select("offset_no", F.lit("raw").alias("source"), "reason", "value")


@query("raw_reject_reasons", "B12, B14, B15, B24", v.sql(JUDGED, "select 'raw' as source, reason, count(*) as messages from judged where reason is not null group by reason"))
def raw_reject_reasons(spark, folder):
    rejects = ql.rejected_messages(judged(spark, folder), "raw")
    return rejects.groupBy("source", "reason").agg(F.count("*").alias("messages"))


@query(
    "scoring_reject_reasons",
    "B13, B14, B17, D10",
    v.sql(f"{v.MESSAGES},\njudged as (select *, {SCORING_REASON} as reason from raw_messages)", "select reason, count(*) as messages from judged group by reason"),
)
def scoring_reject_reasons(spark, folder):
    log = ql.checked(raw_messages(spark, folder), ql.scoring_reason())
    return log.groupBy("reason").agg(F.count("*").alias("messages"))


@query(
    "stage_samples",
    "G8",
    v.sql(
        JUDGED + f""",
staged as (select 'raw' as stage, value, record_ts from judged where json_valid(value)
  union all select 'processed', value, record_ts from judged where reason is null
  union all select 'training', value, record_ts from judged where reason is null and {TRAINING})""",
        f"""select stage, value->>'$._id' as _id, record_ts as timestamp, {SEQ} as packets, {HUMAN} as records from (
          select *, row_number() over (partition by stage order by record_ts) as r from staged where {SEQ} = 16 and json_array_length(value, '$.sequence[0]') = 12) where r = 1""",
    ),
)
def stage_samples(spark, folder):
    raw = ql.readable_messages(raw_messages(spark, folder)).withColumn("stage", F.lit("raw"))
    routed = topics.route(valid(spark, folder)).withColumnRenamed("topic", "stage")
    staged = sinks.union_topics(raw, routed)
    found = sv.stage_samples(staged.withColumn("timestamp", F.col("record_ts")))
    return found.select(
        "stage", "_id", "timestamp", F.size("sequence").cast("long").alias("packets"), F.size("human_readable").cast("long").alias("records")
    )


@query(
    "json_encoding",
    "F1",
    f"""select event_id, concat('{{"id":', cast(event_id as varchar), ',"amount":"', cast(cast(value as decimal(12,2)) as varchar),
      '","at":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end,
      '","name":"', event_type, '","point":[', cast({v.K} as varchar), ',', cast({v.K} % 7 as varchar), '],"kinds":["', event_type, '"],"none":null}}') as document from events""",
)
def json_encoding(spark, folder):
    from netweave.sources.tables import table

    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    document = tx.json_record(
        id=F.col("event_id"),
        amount=F.col("value").cast("decimal(12,2)").cast("string"),
        at=tx.format_iso(F.col("ts")),
        name=tx.utf8(F.encode("event_type", "UTF-8")),
        point=F.array(k, k % 7),
        kinds=F.array_distinct(F.array("event_type", "event_type")),
        none=F.lit(None).cast("string"),
    )
    return table(spark, folder, "events").select("event_id", document.alias("document"))
