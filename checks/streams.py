"""Streams over files that Spark derives from the given tables, run to their end, and capture files written and read."""

from __future__ import annotations

import struct
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

from checks import messages as ms
from checks import views as v
from checks.catalog import query, r6, s6, work_folder
from netweave.operators import scoring as sc
from netweave.operators import serving as sv
from netweave.schemas import PACKET
from netweave.sources import captures, files, topics
from netweave.sources.captures import RECORD_HEADER
from netweave.sources.models import ModelStore
from netweave.sources.tables import ROWS_PER_TASK, packets, predictions, raw_messages, spread, stage_log, table
from netweave.streaming import flows
from netweave.streaming.scoring import ScoringStage
from netweave.streaming.windows import WindowLabeller

# Tasks get the writer with the job, wherever this module is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CUT = "2024-01-12"
BORDER = f"timestamp '{CUT}'"


def timed(rows, *columns):
    """Times as instants, which streams and JSON take."""
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def in_two_runs(rows, column, path, run):
    """The early rows arrive and the stream runs, then the late ones and it runs again from its checkpoint.

    Each task of ``rows`` writes a file. ``run`` gets how many files are half of those that are new: two micro-batches,
    each of which reads its files in parallel.
    """
    before = 0
    for part in (F.col(column) < F.lit(CUT).cast("timestamp"), F.col(column) >= F.lit(CUT).cast("timestamp")):
        rows.filter(part).write.mode("append").parquet(path)
        known = sum(name.endswith(".parquet") for name in files.names(rows.sparkSession, path))
        run(max(1, -(-(known - before) // 2)))
        before = known


def raw_topic(spark, folder):
    log = raw_messages(spark, folder)
    return timed(log.select(F.col("msg_key").alias("key"), "value", "record_ts"), "record_ts")


@query(
    "streamed_routing",
    "T2, T8, A5, A9",
    v.sql(
        ms.JUDGED,
        f"""select msg_key as key, 'rejected' as topic, reason from judged where reason is not null
        union all select msg_key, 'processed', null from judged where reason is null
        union all select msg_key, 'training', null from judged where reason is null and {ms.TRAINING}""",
    ),
)
def streamed_routing(spark, folder):
    base = work_folder(spark, "routing")

    def run(half):
        routed = flows.route_messages(topics.stream_topic(spark, f"{base}/raw", half))
        flows.start_files(routed, f"{base}/out", f"{base}/check", "topic").awaitTermination()

    in_two_runs(raw_topic(spark, folder), "record_ts", f"{base}/raw", run)
    return spark.read.parquet(f"{base}/out").select("key", F.col("topic").cast("string").alias("topic"), "reason")


@query(
    "streamed_scores",
    "T3, D9, D10, D17",
    v.sql(
        f"{v.MESSAGES},\njudged as (select *, {ms.SCORING_REASON} as reason from raw_messages)",
        f"""select msg_key as key, reason, case when reason is null then {s6(f"case when record_ts < {BORDER} then 0.005 else 0.125 end")} end as reconstruction_error,
          case when reason is null then record_ts >= {BORDER} end as is_anomaly, case when reason is null and record_ts >= {BORDER} then 'v1' end as model_version from judged""",
    ),
)
def streamed_scores(spark, folder):
    """No model for the early messages, one saved before the late ones; every message is a prediction or a reject."""
    base = work_folder(spark, "scoring")
    store = ModelStore(spark, f"{base}/models")
    stage = ScoringStage(store, f"{base}/out", f"{base}/rejects", version="best", threshold=0.1)
    runs = []

    def run(half):
        if runs:
            store.save(sc.SubspaceModel(np.full(sc.CELLS, 0.6), np.zeros((sc.CELLS, 0))), 0.5, "2024-01-12T00:00:00Z")
        runs.append(flows.start_batches(topics.stream_topic(spark, f"{base}/raw"), stage, f"{base}/check").awaitTermination())

    in_two_runs(raw_topic(spark, folder), "record_ts", f"{base}/raw", run)
    doc = F.from_json("value", "reconstruction_error double, is_anomaly boolean, model_version string")
    found = spark.read.parquet(f"{base}/out").select("key", F.lit(None).cast("string").alias("reason"), doc.alias("d")).select("key", "reason", "d.*")
    refused = spark.read.parquet(f"{base}/rejects").select("key", "reason")
    return found.unionByName(refused, allowMissingColumns=True).withColumn("reconstruction_error", r6(F.col("reconstruction_error")))


@query(
    "streamed_counters",
    "T4, E1, E2",
    v.sql(v.PREDICTIONS, "select count(*) as total, count(*) filter (where not is_anomaly) as normal, count(*) filter (where is_anomaly) as anomalous from predictions"),
)
def streamed_counters(spark, folder):
    base = work_folder(spark, "counters")
    log = topics.to_topic(timed(spread(predictions(spark, folder)), "timestamp"))

    def run(half):
        counts = flows.counters(topics.stream_topic(spark, f"{base}/in", half))
        flows.start_batches(counts, flows.replace_table(f"{base}/out"), f"{base}/check", "complete").awaitTermination()

    in_two_runs(log, "record_ts", f"{base}/in", run)
    return flows.newest_table(spark, f"{base}/out")


@query(
    "streamed_freshness",
    "T5, E4",
    v.sql(
        v.STAGE_LOG,
        """, now as (select max(timestamp) as t from stage_log), lasts as (select stage, max(timestamp) as t from stage_log group by stage union all select 'backend', t from now)
        select stage, case when (select t from now) - t < interval 900 second then 'healthy' else 'not receiving data' end as status,
          case when (select t from now) - t < interval 900 second then t end as last_update from lasts""",
    ),
)
def streamed_freshness(spark, folder):
    base = work_folder(spark, "freshness")
    rows = timed(spread(stage_log(spark, folder).select("stage", "timestamp")), "timestamp")

    def run(half):
        seen = flows.last_seen(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        flows.start_batches(seen, flows.replace_table(f"{base}/out"), f"{base}/check", "complete").awaitTermination()

    in_two_runs(rows, "timestamp", f"{base}/in", run)
    stages = ["raw", "processed", "training", "predictions", "labeled"]
    health = sv.stage_health(flows.newest_table(spark, f"{base}/out"), stages, limit="900 SECONDS")
    return health.withColumn("last_update", F.col("last_update").cast("timestamp_ntz"))


@query(
    "streamed_windows",
    "T7, J4, B23, A3",
    v.sql(
        v.PACKETS + f""",
early as (select ts as start, ts + interval 5 minute as stop from events where event_type = 'purchase' and ts < {BORDER}),
late as (select ts as start, ts + interval 2 minute as stop from events where event_type = 'signup' union all select * from early)""",
        f"""select packet_id, case when ts < {BORDER} then exists (select 1 from early w where p.ts between w.start and w.stop)
          else exists (select 1 from late w where p.ts between w.start and w.stop) end as is_training from packets p""",
    ),
)
def streamed_windows(spark, folder):
    """Windows that are requested between the two runs count for the packets of the second, not for those already labelled."""
    base = work_folder(spark, "windows")
    events = timed(table(spark, folder, "events"), "ts")
    early = events.filter((F.col("event_type") == "purchase") & (F.col("ts") < F.lit(CUT).cast("timestamp"))).select("ts", F.lit(5).alias("minutes"))
    late = events.filter("event_type = 'signup'").select("ts", F.lit(2).alias("minutes"))
    requested = [early, late]

    def run(half):
        windows = requested.pop(0).select(F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(mins=F.col("minutes"))).alias("end"))
        windows.write.mode("append").parquet(f"{base}/windows")
        handler = WindowLabeller(f"{base}/windows", f"{base}/out")
        flows.start_batches(topics.stream_packets(spark, f"{base}/in"), handler, f"{base}/check").awaitTermination()

    in_two_runs(timed(packets(spark, folder), "ts").select(*PACKET.fieldNames()), "ts", f"{base}/in", run)
    return spark.read.parquet(f"{base}/out").select("packet_id", "is_training")


@query(
    "streamed_floods",
    "T9, E9",
    v.sql(
        v.PACKETS,
        """select time_bucket(interval 6 hour, ts, timestamp '2024-01-01') as window_start, dst_ip, count(*) as packets, cast(sum(udp_len) as bigint) as bytes
        from packets where proto = 17 group by 1, 2 having count(*) >= 3
        and time_bucket(interval 6 hour, any_value(ts), timestamp '2024-01-01') + interval 7 hour <= (select max(ts) from packets where proto = 17)""",
    ),
)
def streamed_floods(spark, folder):
    """Windows that the watermark, an hour behind the newest packet, has closed."""
    base = work_folder(spark, "floods")

    def run(half):
        floods = flows.udp_flood_stream(topics.stream_packets(spark, f"{base}/in"), "6 hours", 3, "1 hour")
        flows.start_files(floods, f"{base}/out", f"{base}/check").awaitTermination()

    in_two_runs(timed(packets(spark, folder), "ts").select(*PACKET.fieldNames()), "ts", f"{base}/in", run)
    return spark.read.parquet(f"{base}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# ---------------------------------------------------------------- captures


def frame_bytes(p) -> bytes:
    """An Ethernet frame whose headers hold the fields of a packet row."""
    if pd.isna(p.proto):
        return bytes(12) + b"\x08\x06" + bytes(int(p.packet_size) - 14)
    addresses = bytes(int(x) for ip in (p.src_ip, p.dst_ip) for x in ip.split("."))
    head = struct.pack(">BBHHHBBH", 0x40 | int(p.ihl), 0, int(p.ip_len), 0, int(p.ip_flags) << 13, int(p.ttl), int(p.proto), 0) + addresses
    body = b""
    if p.proto == 6:
        body = struct.pack(">HHIIBBHHH", int(p.src_port), int(p.dst_port), 0, 0, 0x50, int(p.tcp_flags), int(p.tcp_window), 0, 0)
    elif p.proto == 17:
        body = struct.pack(">HHHH", int(p.src_port), int(p.dst_port), int(p.udp_len), 0)
    data = bytes(12) + b"\x08\x00" + head + body
    return data + bytes(int(p.packet_size) - len(data))


def write_captures(target: str):
    """Partitions of packets, in order of time, as a capture file each; a file gets its name once it is whole."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = local_fs(target)
        name, own = f"{path}/part-{TaskContext.get().partitionId()}.pcap", f"{path}/{uuid.uuid4().hex}.writing"
        store.create_dir(path, recursive=True)
        with store.open_output_stream(own) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
            for rows in batches:
                for p in rows.itertuples():
                    data, micros = frame_bytes(p), int(p.micros)
                    out.write(struct.pack("<IIII", micros // 10**6, micros % 10**6, len(data), len(data)) + data)
        store.move(own, name)
        yield pd.DataFrame({"name": [name]})

    return written


def local_fs(target: str):
    return pafs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (pafs.LocalFileSystem(), target)


FIELDS = [f for f in PACKET.fieldNames() if f not in ("packet_id", "sensor_id", "ts")]


@query(
    "capture_round_trip",
    "A1, U2, B6",
    v.sql(v.PACKETS, f"select ts, {', '.join(FIELDS)} from packets"),
)
def capture_round_trip(spark, folder):
    """Packets written as capture files, and decoded from pieces that begin anywhere."""
    base = work_folder(spark, "captures")
    rows = packets(spark, folder).withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    tasks = max(7, -(-rows.count() // ROWS_PER_TASK))
    ordered = rows.repartitionByRange(tasks, "micros").sortWithinPartitions("micros")
    ordered.mapInPandas(write_captures(base), "name string").count()
    found = captures.read_captures(spark, base, piece_bytes=RECORD_HEADER * 2000)
    return found.select(F.col("ts").cast("timestamp_ntz").alias("ts"), *FIELDS)
