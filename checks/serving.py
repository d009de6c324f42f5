"""Counters, health, pages, feedback and display text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.catalog import query, r6, s6
from checks.sequences import sequences
from netweave.functions import text as tx
from netweave.operators import serving as sv
from netweave.sources.tables import feedback, job_status, predictions, stage_log, table

START, END = "2024-01-05 06:00:00", "2024-01-12 00:00:00"
MARKS = v.PREDICTIONS + "," + v.FEEDBACK
ERROR = s6("reconstruction_error")


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def anomalies(spark, folder):
    return predictions(spark, folder).filter("is_anomaly")


def shown(rows):
    return rows.select("_id", "timestamp", r6(F.col("reconstruction_error")).alias("reconstruction_error"))


@query(
    "inclusive_time_range",
    "B20",
    v.sql(v.PREDICTIONS, f"select _id, timestamp, {ERROR} as reconstruction_error from predictions where timestamp >= timestamp '{START}' and timestamp <= timestamp '{END}'"),
)
def inclusive_time_range(spark, folder):
    return shown(sv.time_range(predictions(spark, folder), at(START), at(END)))


WHOLE_DAYS = f"timestamp >= timestamp '{START}' and timestamp < timestamp '{END}' + interval 1 day"


@query("whole_day_range", "B21, B22", v.sql(v.PREDICTIONS, f"select _id, timestamp from predictions where {WHOLE_DAYS}"))
def whole_day_range(spark, folder):
    return sv.whole_day_range(predictions(spark, folder), at(START), at(END)).select("_id", "timestamp")


@query("pruned_listing", "B22", v.sql(v.PREDICTIONS, "select _id, timestamp from predictions"))
def pruned_listing(spark, folder):
    return predictions(spark, folder).select("_id", "timestamp")


@query(
    "prediction_counters",
    "E1",
    v.sql(v.PREDICTIONS, "select count(*) as total, count(*) filter (where not is_anomaly) as normal, count(*) filter (where is_anomaly) as anomalous from predictions"),
)
def prediction_counters(spark, folder):
    return sv.prediction_counts(predictions(spark, folder))


@query(
    "running_counters",
    "E2",
    v.sql(
        v.PREDICTIONS,
        """select _id, count(*) over w as total, count(*) filter (where not is_anomaly) over w as normal, count(*) filter (where is_anomaly) over w as anomalous
        from predictions window w as (order by timestamp, _id rows unbounded preceding)""",
    ),
)
def running_counters(spark, folder):
    return sv.running_counts(predictions(spark, folder)).select("_id", "total", "normal", "anomalous")


@query("page_totals", "E3", v.sql(v.PREDICTIONS, f'select count(*) as "rows", cast(ceil(count(*) / 10.0) as bigint) as pages from predictions where {WHOLE_DAYS}'))
def page_totals(spark, folder):
    return sv.page_totals(sv.whole_day_range(predictions(spark, folder), at(START), at(END)))


@query(
    "stage_freshness",
    "E4",
    v.sql(
        v.STAGE_LOG,
        """, now as (select max(timestamp) as t from stage_log),
        lasts as (select s.stage, max(l.timestamp) as t from (values ('raw'), ('processed'), ('predictions')) s(stage) left join stage_log l on l.stage = s.stage group by s.stage
          union all select 'backend', t from now)
        select stage, case when coalesce((select t from now) - t < interval 600 second, false) then 'healthy' else 'not receiving data' end as status,
          case when (select t from now) - t < interval 600 second then t end as last_update from lasts""",
    ),
)
def stage_freshness(spark, folder):
    return sv.stage_health(stage_log(spark, folder), ["raw", "processed", "predictions"], limit="600 SECONDS")


@query(
    "traffic_ratio",
    "E5",
    v.sql(v.PREDICTIONS, "select case when is_anomaly then 'Anomalous' else 'Normal' end as name, count(*) as value from predictions group by 1"),
)
def traffic_ratio(spark, folder):
    return sv.traffic_ratio(predictions(spark, folder))


@query(
    "job_states",
    "E6",
    v.sql(
        v.JOBS,
        f""", requests as (select distinct concat('job', cast(case when {v.K} = 0 then -1 else user_id end as varchar)) as job_id from events),
        newest as (select job_id, max_by(status, event_ts) as status, max_by(progress, event_ts) as progress, max_by(message, event_ts) as message from job_status group by job_id)
        select r.job_id, coalesce(n.status, 'not_found') as status, coalesce(n.progress, 0) as progress, coalesce(n.message, 'Job not found') as message
        from requests r left join newest n on r.job_id = n.job_id""",
    ),
)
def job_states(spark, folder):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    user = F.when(k == 0, -1).otherwise(F.col("user_id")).cast("string")
    requests = table(spark, folder, "events").select(F.concat(F.lit("job"), user).alias("job_id")).distinct()
    return sv.job_states(requests, job_status(spark, folder))


@query(
    "anomalies_without_false_positives",
    "J1",
    v.sql(MARKS, f"select _id, timestamp, {ERROR} as reconstruction_error from anomalies where _id not in (select _id from feedback where _id is not null)"),
)
def anomalies_without_false_positives(spark, folder):
    return shown(sv.without_false_positives(anomalies(spark, folder), feedback(spark, folder)))


@query(
    "feedback_labels",
    "J2",
    v.sql(
        MARKS,
        f""", marks as (select _id, min(marked_at) as marked_at from feedback where _id is not null group by _id)
        select a._id, m.marked_at as timestamp, false as is_anomaly, true as is_false_positive, false as is_training,
          {s6('a.reconstruction_error')} as reconstruction_error, {s6('a.familiarity')} as familiarity from anomalies a join marks m on a._id = m._id""",
    ),
)
def feedback_labels(spark, folder):
    rows = sv.labeled_records(anomalies(spark, folder), feedback(spark, folder))
    return rows.withColumns({c: r6(F.col(c)) for c in ("reconstruction_error", "familiarity")})


@query(
    "feedback_refusals",
    "J2",
    v.sql(
        MARKS,
        """select _id, marked_at, case when _id is null then 'missing_id' else 'not_found' end as reason from feedback f
        where _id is null or not exists (select 1 from anomalies a where a._id = f._id)""",
    ),
)
def feedback_refusals(spark, folder):
    return sv.refused_marks(anomalies(spark, folder), feedback(spark, folder))


@query("stored_page", "G1", v.sql(v.PREDICTIONS, f"select _id, timestamp, {ERROR} as reconstruction_error from predictions order by timestamp, _id limit 10 offset 20"))
def stored_page(spark, folder):
    return shown(sv.page(predictions(spark, folder), 3, 10))


@query("day_range_page", "G2", v.sql(v.PREDICTIONS, f"select _id, timestamp from predictions where {WHOLE_DAYS} order by timestamp, _id limit 10 offset 10"))
def day_range_page(spark, folder):
    rows = sv.whole_day_range(predictions(spark, folder), at(START), at(END)).select("_id", "timestamp")
    return sv.page(rows, 2, 10)


LEFT = "select * from anomalies where _id not in (select _id from feedback where _id is not null)"


@query(
    "anomaly_page",
    "G3",
    v.sql(
        MARKS,
        f""", kept as ({LEFT})
        select _id, timestamp, {ERROR} as reconstruction_error, (select cast(ceil(count(*) / 10.0) as bigint) from kept) as pages from kept order by timestamp, _id limit 10""",
    ),
)
def anomaly_page(spark, folder):
    kept = sv.without_false_positives(anomalies(spark, folder), feedback(spark, folder))
    pages = sv.page_totals(kept).select("pages").scalar()
    return shown(sv.page(kept, 1, 10)).withColumn("pages", pages)


@query(
    "anomaly_page_of_five",
    "G4",
    v.sql(v.PREDICTIONS, f"select _id, timestamp, {ERROR} as reconstruction_error, (select count(*) from anomalies) as total from anomalies order by timestamp, _id limit 5 offset 5"),
)
def anomaly_page_of_five(spark, folder):
    rows = anomalies(spark, folder)
    total = rows.agg(F.count("*")).scalar()
    return shown(sv.page(rows, 2, sv.ANOMALY_PAGE_SIZE)).withColumn("total", total)


@query(
    "newest_thousand",
    "G6",
    v.sql(v.PREDICTIONS, f"select _id, timestamp, {ERROR} as reconstruction_error from anomalies order by timestamp desc, _id desc limit 1000"),
)
def newest_thousand(spark, folder):
    return shown(sv.newest_kept(anomalies(spark, folder)))


@query(
    "push_payload",
    "G7",
    v.sql(v.PREDICTIONS, f"select _id, timestamp, {ERROR} as reconstruction_error, (select count(*) from anomalies) as total from anomalies order by timestamp desc, _id desc limit 5"),
)
def push_payload(spark, folder):
    rows = sv.push_payload(anomalies(spark, folder))
    return rows.select("_id", "timestamp", r6(F.col("reconstruction_error")).alias("reconstruction_error"), "total")


@query(
    "page_clamp",
    "G9",
    f"""with totals as (select cast(ceil(count(*) / 100.0) as bigint) as pages from events)
    select event_id, greatest({v.K} - 1, 1) as previous_page, least({v.K} + 1, (select pages from totals)) as next_page from events""",
)
def page_clamp(spark, folder):
    events = table(spark, folder, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    pages = sv.page_totals(events, 100).select("pages").scalar()
    before, after = sv.neighbour_pages(k, pages)
    return events.select("event_id", before.alias("previous_page"), after.alias("next_page"))


@query("ascending_errors", "G10", v.sql(v.PREDICTIONS, f"select _id, {ERROR} as reconstruction_error from predictions order by reconstruction_error, _id"))
def ascending_errors(spark, folder):
    return predictions(spark, folder).orderBy("reconstruction_error", "_id").select("_id", r6(F.col("reconstruction_error")).alias("reconstruction_error"))


@query(
    "newest_first_merge",
    "S2",
    v.sql(
        v.PREDICTIONS,
        f""", merged as (select 0 as batch, * from anomalies where timestamp >= timestamp '{END}'
          union all select 1, * from anomalies where timestamp < timestamp '{END}')
        select cast(batch as int) as batch, _id, timestamp from merged order by batch, timestamp desc, _id desc limit 1000""",
    ),
)
def newest_first_merge(spark, folder):
    rows = anomalies(spark, folder)
    fresh, older = rows.filter(F.col("timestamp") >= at(END)), rows.filter(F.col("timestamp") < at(END))
    return sv.merge_newest_first(fresh, older).select("batch", "_id", "timestamp")


@query(
    "list_difference",
    "S3",
    v.sql(
        v.STAGE_LOG,
        """, listed as (select _id, stage from stage_log where stage <> 'labeled'), gone as (select _id, 'raw' as stage from stage_log where stage = 'labeled')
        select _id, stage from listed l where not exists (select 1 from gone g where g._id is not distinct from l._id and g.stage is not distinct from l.stage)""",
    ),
)
def list_difference(spark, folder):
    log = stage_log(spark, folder)
    listed = log.filter(F.col("stage") != "labeled").select("_id", "stage")
    gone = log.filter(F.col("stage") == "labeled").select("_id", F.lit("raw").alias("stage"))
    return sv.list_difference(listed, gone)


@query(
    "epoch_millis",
    "F3",
    "select event_id, epoch_us(ts) // 1000 as millis, date_trunc('millisecond', ts) as at from events",
)
def epoch_millis(spark, folder):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, folder, "events").select("event_id", millis.alias("millis"))
    return rows.withColumn("at", tx.from_epoch_millis(F.col("millis")).cast("timestamp_ntz"))


@query(
    "iso_times",
    "F4",
    """select event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end) as iso, ts as parsed from events""",
)
def iso_times(spark, folder):
    rows = table(spark, folder, "events").select("event_id", tx.format_iso(F.col("ts")).alias("iso"))
    return rows.withColumn("parsed", tx.parse_iso(F.concat("iso", F.lit("Z"))).cast("timestamp_ntz"))


@query("time_of_day_text", "F5", "select event_id, case when event_type = 'error' then '' else strftime(ts, '%H:%M:%S') end as shown from events")
def time_of_day_text(spark, folder):
    ts = F.when(F.col("event_type") != "error", F.col("ts"))
    return table(spark, folder, "events").select("event_id", tx.time_of_day(ts).alias("shown"))


@query(
    "truncated_text",
    "F6",
    """select doc_id, case when length(text) <= 12 then text else concat(left(text, 12), '...') end as shown,
      case when length(source) <= 3 then source else concat(left(source, 3), '...') end as short_source,
      concat(left(concat('{"lang":"', lang, '","n_chars":', cast(n_chars as varchar), '}'), 12), '...') as shown_record from documents""",
)
def truncated_text(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        tx.truncate_text(F.col("text")).alias("shown"),
        tx.truncate_text(F.col("source"), 3).alias("short_source"),
        tx.truncate_value(F.struct("lang", "n_chars")).alias("shown_record"),
    )


@query(
    "four_decimal_text",
    "F7",
    f"""with n as (select event_id, {v.K} % 5 as k, user_id / 7.0e0 as x from events)
    select event_id, case when k in (0, 1) or x = 0 then 'N/A' else printf('%.4f', x) end as error,
      case when k = 0 then 'N/A' when k = 1 then '0.0000' else printf('%.4f', x) end as familiarity from n""",
)
def four_decimal_text(spark, folder):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 5
    rows = table(spark, folder, "events").select("event_id", k.alias("k"), (F.col("user_id") / 7.0).alias("x"))
    number = F.when(F.col("k") == 0, F.lit(None)).when(F.col("k") == 1, 0.0).otherwise(F.col("x"))
    return rows.select(
        "event_id", tx.four_decimals(number, True).alias("error"), tx.four_decimals(number, False).alias("familiarity")
    )


@query("capitalised_text", "F8", "select event_id, concat(upper(left(event_type, 1)), substr(event_type, 2)) as label from events")
def capitalised_text(spark, folder):
    return table(spark, folder, "events").select("event_id", tx.capitalise_first(F.col("event_type")).alias("label"))


@query(
    "status_classes",
    "F9",
    """select event_id, case event_type when 'view' then 'status-healthy' when 'click' then 'loading' else 'status-unhealthy' end as css_class from events""",
)
def status_classes(spark, folder):
    status = F.when(F.col("event_type") == "view", "healthy").when(F.col("event_type") == "click", "Unknown").otherwise("down")
    return table(spark, folder, "events").select("event_id", tx.status_class(status).alias("css_class"))


@query(
    "packet_table_view",
    "F10, J7",
    v.sql(
        v.PLACED,
        f"""select sha256(concat_ws('|', sensor_id, cast(epoch as varchar), cast(seq_no as varchar))) as _id, pos, src_ip, dst_ip, {v.NAME_SQL} as protocol,
          case when proto in (6, 17) then src_port else 0 end as src_port, case when proto in (6, 17) then dst_port else 0 end as dst_port, ip_flags as flags from placed""",
    ),
)
def packet_table_view(spark, folder):
    return sv.packet_table(sequences(spark, folder))


@query("pretty_documents", "F11")
def pretty_documents(spark, folder):
    return sv.document_cards(predictions(spark, folder))


