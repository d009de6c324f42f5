"""What the analyst's screen asks for: counters, health, pages, feedback, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions.text import truncate_text
from netweave.operators.quality import sample_shape
from netweave.plans.ordering import ROWS_PER_SPLIT, Total, rows_between, running
from netweave.plans.small import broadcast_if_small
from netweave.schemas import KEPT_ANOMALIES
from netweave.sources.topics import TIME_FORMAT

# Page sizes and the newest rows pushed to a client.
PAGE_SIZE = 10
ANOMALY_PAGE_SIZE = 5
PUSHED = 5
NEWEST_FIRST = ["timestamp", "_id"]


def prediction_counts(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_anomaly")).alias("normal"),
        F.count_if(F.col("is_anomaly")).alias("anomalous"),
    )


def running_counts(predictions: DataFrame, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """The three counters as they stood after each prediction."""
    totals = {
        "total": Total("sum", F.lit(1).cast("long")),
        "normal": Total("sum", (~F.col("is_anomaly")).cast("long")),
        "anomalous": Total("sum", F.col("is_anomaly").cast("long")),
    }
    return running(predictions, ["timestamp", "_id"], totals, rows_per_split=rows_per_split)


def page_totals(rows: DataFrame, per_page: int = PAGE_SIZE) -> DataFrame:
    return rows.agg(F.count("*").alias("rows")).withColumn(
        "pages", F.floor((F.col("rows") + per_page - 1) / per_page).cast("long")
    )


def page(rows: DataFrame, number: int = 1, per_page: int = PAGE_SIZE, order: list[str] | None = None) -> DataFrame:
    """Rows of one page. The order makes pages repeatable and gap-free."""
    return rows.orderBy(*(order or ["timestamp", "_id"])).offset((number - 1) * per_page).limit(per_page)


def deep_page(
    rows: DataFrame, number: int, per_page: int = PAGE_SIZE, order: list[str] | None = None, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """The rows of ``page`` with their place, wherever the page is: nothing before it is sorted or gathered."""
    first = (number - 1) * per_page
    return rows_between(rows, order or ["timestamp", "_id"], first, first + per_page, "place", rows_per_split=rows_per_split)


def neighbour_pages(current: Column, total: Column) -> tuple[Column, Column]:
    return F.greatest(current - 1, F.lit(1)), F.least(current + 1, total)


def time_range(rows: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Both ends are part of the range and both are optional."""
    if start is not None:
        rows = rows.filter(F.col("timestamp") >= start)
    if end is not None:
        rows = rows.filter(F.col("timestamp") <= end)
    return rows


def whole_day_range(rows: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The last day counts to its end."""
    if start is not None:
        rows = rows.filter(F.col("timestamp") >= start)
    if end is not None:
        rows = rows.filter(F.col("timestamp") < end + F.expr("INTERVAL 1 DAY"))
    return rows


def stage_health(stage_log: DataFrame, stages: list[str], as_of: Column | None = None, limit: str = "1 SECOND") -> DataFrame:
    """Last event per stage; healthy while it is younger than ``limit``.

    ``as_of`` defaults to the newest event of all. The log is reduced to one row
    before anything else happens.
    """
    newest = [F.max(F.when(F.col("stage") == s, F.col("timestamp"))).alias(f"_{i}") for i, s in enumerate(stages)]
    summary = stage_log.agg(F.max("timestamp").alias("_newest"), *newest)
    now = F.col("_newest") if as_of is None else as_of
    entries = [
        F.struct(F.lit(s).alias("stage"), F.col(f"_{i}").alias("last")) for i, s in enumerate(stages)
    ]
    entries.append(F.struct(F.lit("backend").alias("stage"), F.col("_now").alias("last")))
    fresh = F.coalesce(F.col("_now") - F.col("last") < F.expr(f"INTERVAL {limit}"), F.lit(False))
    return (
        summary.withColumn("_now", now)
        .select("_now", F.inline(F.array(*entries)))
        .select(
            "stage",
            F.when(fresh, "healthy").otherwise("not receiving data").alias("status"),
            F.when(fresh, F.col("last")).alias("last_update"),
        )
    )


def traffic_ratio(predictions: DataFrame) -> DataFrame:
    """Two rows for a two-bar chart."""
    counts = prediction_counts(predictions)
    return counts.select("normal", "anomalous").unpivot(
        [], [F.col("normal").alias("Normal"), F.col("anomalous").alias("Anomalous")], "name", "value"
    )


def job_states(requests: DataFrame, job_status: DataFrame) -> DataFrame:
    """Newest state of each requested job; an unknown job is reported as not found."""
    newest = job_status.groupBy("job_id").agg(
        F.max_by(F.struct("status", "progress", "message"), "event_ts").alias("s")
    )
    return requests.join(newest, "job_id", "left").select(
        "job_id",
        F.coalesce("s.status", F.lit("not_found")).alias("status"),
        F.coalesce("s.progress", F.lit(0)).alias("progress"),
        F.coalesce("s.message", F.lit("Job not found")).alias("message"),
    )


def without_false_positives(anomalies: DataFrame, marks: DataFrame) -> DataFrame:
    return anomalies.join(marks.select("_id").distinct(), "_id", "left_anti")


def labeled_records(anomalies: DataFrame, marks: DataFrame, marked_at: Column | None = None) -> DataFrame:
    """One labelled record per marked anomaly: no anomaly, a false positive, no training.

    Several copies of an anomaly give one record, the earliest.
    """
    marked = marks.filter(F.coalesce(F.col("_id") != "", F.lit(False))).groupBy("_id").agg(F.min("marked_at").alias("marked_at"))
    payload = F.struct(*[c for c in anomalies.columns if c != "_id"])
    asked = anomalies.join(marked.select("_id"), "_id", "left_semi")  # marks are few: payloads of others do not move
    earliest = asked.groupBy("_id").agg(F.min_by(payload, "timestamp").alias("a"))
    return (
        earliest.join(marked, "_id")
        .select("_id", "marked_at", "a.*")
        .withColumns(
            {
                "timestamp": F.col("marked_at") if marked_at is None else marked_at,
                "is_anomaly": F.lit(False),
                "is_false_positive": F.lit(True),
                "is_training": F.lit(False),
            }
        )
        .drop("marked_at")
    )


def refused_marks(anomalies: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks that changed nothing, with the reason; an empty id is a missing one."""
    given = F.coalesce(F.col("_id") != "", F.lit(False))
    missing = marks.filter(~given).withColumn("reason", F.lit("missing_id"))
    unknown = (
        marks.filter(given)
        .join(anomalies.select("_id").distinct(), "_id", "left_anti")
        .withColumn("reason", F.lit("not_found"))
    )
    return missing.unionByName(unknown)


def trained_membership(packets: DataFrame, trained_pairs: DataFrame) -> DataFrame:
    """Flag packets whose address pair is in the training set."""
    known = trained_pairs.select("src_ip", "dst_ip").distinct().withColumn("_known", F.lit(True))
    return packets.join(broadcast_if_small(known), ["src_ip", "dst_ip"], "left").withColumn(
        "known_pair", F.coalesce("_known", F.lit(False))
    ).drop("_known")


def packet_rows(sequences: DataFrame) -> DataFrame:
    """One row per packet: its features beside its readable record."""
    pairs = F.arrays_zip("sequence", "human_readable")
    return sequences.select("_id", F.posexplode(pairs).alias("pos", "p")).select(
        "_id", "pos", F.col("p.sequence").alias("features"), F.col("p.human_readable").alias("human")
    )


def packet_table(sequences: DataFrame) -> DataFrame:
    """Readable packet columns of a sequence."""
    return packet_rows(sequences).select(
        "_id",
        "pos",
        *[F.col(f"human.{c}").alias(c) for c in ("src_ip", "dst_ip", "protocol", "src_port", "dst_port", "flags")],
    )


def document_cards(rows: DataFrame) -> DataFrame:
    return rows.select("_id", F.format_string("%.4f", "reconstruction_error").alias("error"), F.to_json(
        F.struct("familiarity", "is_anomaly", "timestamp"), {"pretty": "true", **TIME_FORMAT, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    ).alias("document"))


def newest_kept(anomalies: DataFrame, kept: int = KEPT_ANOMALIES) -> DataFrame:
    return anomalies.orderBy(*[F.col(c).desc() for c in NEWEST_FIRST]).limit(kept)


def push_payload(anomalies: DataFrame, newest: int = PUSHED) -> DataFrame:
    """The newest rows, each with the number of all rows."""
    total = anomalies.agg(F.count("*")).scalar()
    return newest_kept(anomalies, newest).withColumn("total", total)


def merge_newest_first(fresh: DataFrame, older: DataFrame, kept: int = KEPT_ANOMALIES) -> DataFrame:
    """New batch before the old one, duplicates kept, cut to the newest ``kept``."""
    both = fresh.withColumn("batch", F.lit(0)).unionByName(older.withColumn("batch", F.lit(1)))
    return both.orderBy("batch", *[F.col(c).desc() for c in NEWEST_FIRST]).limit(kept)


def list_difference(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Every copy of a removed row goes; unmatched duplicates stay. Nulls compare equal."""
    right = removed.select(*[F.col(c).alias(f"_r_{c}") for c in rows.columns]).distinct()
    same = [rows[c].eqNullSafe(F.col(f"_r_{c}")) for c in rows.columns]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return rows.join(right, condition, "left_anti")


def shared_pairs(seen: DataFrame, trained: DataFrame) -> DataFrame:
    columns = ["src_ip", "dst_ip"]
    return seen.select(*columns).intersect(trained.select(*columns))


def stage_samples(messages: DataFrame) -> DataFrame:
    """The earliest well-shaped record of each stage."""
    payload = F.struct("_id", "timestamp", "sequence", "human_readable")
    return (
        messages.filter(sample_shape(F.col("sequence")))
        .groupBy("stage")
        .agg(F.min_by(payload, F.struct("timestamp", "_id")).alias("m"))
        .select("stage", "m.*")
    )


def short_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_id", truncate_text(F.col("_id")))
