"""Network tables derived from the given ``events``, ``documents`` and other tables.

The source log has no packet headers, so every header field is a fixed function of
an event. Each view keeps all rows of its table unless its meaning is a kind of
event (a training run, an analyst mark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.plans.once import computed_once
from netweave.plans.ordering import ordinals
from netweave.schemas import PACKET, STAGES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of which a task makes wide ones, at most about: a message takes some 4 kB once it is parsed.
ROWS_PER_TASK = 50_000


def spread(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of a file with few splits dealt to all cores, and to more tasks where the table is larger, before something
    wide is made of each; others as they are."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_per_task))
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def _props_number() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """One header row per event. ``proto`` is null when there is no IP layer."""
    events = spread(table(spark, folder, "events"))
    kind, k, event_id = F.col("event_type"), F.col("k"), F.col("event_id")
    proto = (
        F.when(kind.isin("view", "click"), 6)
        .when(kind == "signup", 17)
        .when(kind == "error", 1)
        .when(k % 10 == 0, 2)
        .when(k % 10 == 1, F.lit(None))
        .when(k % 10 == 2, 47)
        .otherwise(17)
    )
    known = F.col("proto").isNotNull()
    has_ports = F.col("proto").isin(6, 17)
    is_tcp, is_udp = F.col("proto") == 6, F.col("proto") == 17
    service_port = (
        F.when(k % 6 == 0, 80)
        .when(k % 6 == 1, 443)
        .when(k % 6 == 2, 53)
        .when(k % 6 == 3, 22)
        .when(k % 6 == 4, 8080)
        .otherwise(1 + (event_id * 13) % 1000)
    )
    flags = F.when(k % 5 == 0, 2).when(k % 5 == 1, 18).when(k % 5 == 2, 16).when(k % 5 == 3, 24).otherwise(4)
    size = (event_id * 37) % 1460

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    user = F.col("user_id")
    source = text("10.0.", (user % 3).cast("string"), ".", (user % 256).cast("string"))
    target = text("192.168.", (k % 4).cast("string"), ".", (1 + k % 7).cast("string"))
    placed = computed_once(computed_once(events, k=_props_number()), proto=proto.cast("int"))
    headers = dict(
        src_ip=F.when(known, source),
        dst_ip=F.when(known, target),
        ip_len=F.when(known, 40 + size).cast("int"),
        ihl=F.when(known, 5 - 3 * (k == 99).cast("int")).cast("int"),
        ip_flags=F.when(known, (k % 4) * 2 % 8).cast("int"),
        ttl=F.when(known, 32 + k).cast("int"),
        src_port=F.when(has_ports, 1024 + (event_id * 7919) % 64512).cast("int"),
        dst_port=F.when(has_ports, service_port).cast("int"),
        tcp_flags=F.when(is_tcp, flags).cast("int"),
        tcp_window=F.when(is_tcp, (event_id * 131) % 65536).cast("int"),
        udp_len=F.when(is_udp, 20 + size).cast("int"),
        packet_size=F.when(known, 54 + size).otherwise(42).cast("int"),
    )
    return computed_once(placed, **headers).select(
        event_id.alias("packet_id"),
        text("s", (user % 4).cast("string")).alias("sensor_id"),
        *[f.name for f in PACKET.fields[2:]],
    )


def raw_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed JSON log, a fixed share of it damaged in one of six ways."""
    events = spread(table(spark, folder, "events")).withColumn("d", F.col("event_id") % 20)
    damage, key = F.col("d"), F.concat(F.lit("m"), F.col("event_id").cast("string"))
    row = "[" + ",".join(["0.1"] * 12) + "]"
    short_row = "[" + ",".join(["0.1"] * 11) + "]"

    def repeated(text: str, short: Column) -> Column:
        return F.when(short, F.repeat(F.lit(text), F.lit(14))).otherwise(F.repeat(F.lit(text), F.lit(15)))

    training = (
        F.when(damage == 2, "")
        .when(F.col("user_id") % 5 == 0, '"is_training":true,')
        .otherwise('"is_training":false,')
    )
    whole = F.concat(
        F.lit('{"_id":"'),
        key,
        F.lit('","timestamp":"2024-01-01T00:00:00.000","sequence":['),
        F.when(damage == 5, short_row).otherwise(row),
        repeated("," + row, damage == 3),
        F.lit('],"human_readable":[{"src_ip":"10.0.0.1"}'),
        repeated(',{"src_ip":"10.0.0.1"}', damage.isin(3, 4)),
        F.lit("],"),
        training,
        F.when(damage == 1, "").otherwise('"familiarity":0.25,'),
        F.lit('"is_anomaly":false,"is_false_positive":false,"reconstruction_error":null}'),
    )
    broken = F.concat(F.lit('{"_id":"'), key, F.lit('",'))
    return events.select(
        F.col("event_id").alias("offset_no"),
        F.col("ts").alias("record_ts"),
        key.alias("msg_key"),
        F.when(damage == 0, broken).otherwise(whole).alias("value"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("_id"),
        F.col("ts").alias("timestamp"),
        (F.col("value") / 500).alias("reconstruction_error"),
        (F.col("value") / 500 >= 0.5).alias("is_anomaly"),
        (F.col("user_id") % 5 == 0).alias("is_training"),
        F.lit(False).alias("is_false_positive"),
        (_props_number().cast("double") / 100).alias("familiarity"),
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Analyst marks: strong events and sign-ups, some with a missing or unknown id."""
    k, event_id = F.col("k"), F.col("event_id").cast("string")
    return (
        table(spark, folder, "events")
        .withColumn("k", _props_number())
        .filter((F.col("value") > 300) | (F.col("event_type") == "signup"))
        .select(
            F.when(k % 10 == 0, F.lit(None))
            .when(k % 10 == 1, F.concat(F.lit("x"), event_id))
            .otherwise(F.concat(F.lit("m"), event_id))
            .alias("_id"),
            F.col("ts").alias("marked_at"),
        )
    )


def stage_log(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of all stages, several per ``_id``."""
    kinds = ["view", "click", "signup", "purchase"]
    stage, rank = F, F
    for position, kind in enumerate(kinds):
        stage = stage.when(F.col("event_type") == kind, STAGES[position])
        rank = rank.when(F.col("event_type") == kind, position)
    return table(spark, folder, "events").select(
        F.concat(F.lit("m"), (F.col("event_id") % 500).cast("string")).alias("_id"),
        stage.otherwise(STAGES[-1]).alias("stage"),
        rank.otherwise(len(kinds)).alias("stage_rank"),
        F.col("ts").alias("timestamp"),
        (F.col("value") / 500).alias("reconstruction_error"),
    )


def training_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One validation loss per run and step."""
    losses = table(spark, folder, "events").select(
        (F.col("user_id") % 10).alias("run_id"),
        "event_id",
        (F.col("value") / 100).alias("val_loss"),
    )
    return ordinals(losses, ["event_id"], "step", ["run_id"]).drop("event_id")


def model_registry(spark: SparkSession, folder: str) -> DataFrame:
    """One model version per purchase event, numbered in event order."""
    saved = table(spark, folder, "events").filter(F.col("event_type") == "purchase")
    return ordinals(saved, ["event_id"], "seq").select(
        F.concat(F.lit("v"), F.col("seq").cast("string")).alias("version"),
        "seq",
        F.concat(F.lit("/models/checkpoints/m_"), F.col("event_id").cast("string"), F.lit(".bin")).alias(
            "checkpoint_path"
        ),
        (F.col("value") / 500).alias("validation_loss"),
        F.col("ts").alias("creation_date"),
    )


def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("ts").alias("event_ts"),
        F.col("event_type").alias("status"),
        _props_number().alias("progress"),
        F.col("props").alias("message"),
    )
