"""Record layouts shared by the batch and streaming operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Sequence shape, reset size and thresholds of the analysed system.
SEQUENCE_LENGTH = 16
FEATURE_COUNT = 12
RESET_EVERY = 10_000
ANOMALY_THRESHOLD = 0.5
NORMAL_SHARE = 0.9
SCORING_BATCH = 32
PATIENCE = 5
KEPT_ANOMALIES = 1000

FEATURES = [f"f{i}" for i in range(FEATURE_COUNT)]

PACKET = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("ip_len", T.IntegerType()),
        T.StructField("ihl", T.IntegerType()),
        T.StructField("ip_flags", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("udp_len", T.IntegerType()),
        T.StructField("packet_size", T.IntegerType()),
    ]
)

HUMAN = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("window", T.IntegerType()),
        T.StructField("udp_len", T.IntegerType()),
        T.StructField("flags_or_len", T.IntegerType()),
        T.StructField("window_or_padding", T.IntegerType()),
        T.StructField("packet_size", T.IntegerType()),
        T.StructField("avg_inter_packet_time", T.DoubleType()),
    ]
)

MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))

MESSAGE = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("sequence", MATRIX),
        T.StructField("human_readable", T.ArrayType(HUMAN)),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("is_training", T.BooleanType()),
        T.StructField("is_false_positive", T.BooleanType()),
        T.StructField("reconstruction_error", T.DoubleType()),
        T.StructField("familiarity", T.DoubleType()),
    ]
)

TOPIC = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("record_ts", T.TimestampType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("checkpoint_path", T.StringType()),
        T.StructField("validation_loss", T.DoubleType()),
        T.StructField("creation_date", T.TimestampType()),
        T.StructField("is_best", T.BooleanType()),
    ]
)

JOB_STATUS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("message", T.StringType()),
    ]
)

# Keys a raw message must carry. ``familiarity`` is read unconditionally later on,
# so a message without it is refused as well.
RAW_KEYS = [
    "_id",
    "timestamp",
    "sequence",
    "is_training",
    "human_readable",
    "is_anomaly",
    "is_false_positive",
    "reconstruction_error",
    "familiarity",
]
SCORING_KEYS = ["_id", "sequence", "timestamp", "is_training", "familiarity"]

# Stage order of the log, lowest first; ties in time go to the later stage.
STAGES = ["raw", "processed", "training", "predictions", "labeled"]
