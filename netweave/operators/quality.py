"""Message checks: each splits a log into good rows and rejects with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.plans.once import computed_once
from netweave.schemas import FEATURE_COUNT, MESSAGE, RAW_KEYS, SCORING_KEYS, SEQUENCE_LENGTH

# A corrupt record is kept beside the parsed fields, so a broken message is told
# apart from one whose fields are all null.
PARSED = T.StructType([*MESSAGE.fields, T.StructField("_corrupt_record", T.StringType())])
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def parse_message(value: Column) -> Column:
    return F.from_json(value, PARSED, JSON_OPTIONS)


def is_json_object(value: Column) -> Column:
    return F.json_object_keys(value).isNotNull()


def includes_keys(present: Column, keys: list[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in keys])
    return F.coalesce(F.size(F.array_except(wanted, present)) == 0, F.lit(False))


def has_keys(value: Column, keys: list[str]) -> Column:
    """All keys are present; a present key may hold null. False for broken JSON."""
    return includes_keys(F.json_object_keys(value), keys)


def right_length(sequence: Column, length: int = SEQUENCE_LENGTH) -> Column:
    return F.coalesce(F.size(sequence) == length, F.lit(False))


def parallel(sequence: Column, records: Column) -> Column:
    return F.coalesce(F.size(sequence) == F.size(records), F.lit(False))


def sample_shape(sequence: Column) -> Column:
    """Right length, and the first row has the right width; later rows are not looked at."""
    return F.coalesce(
        (F.size(sequence) == SEQUENCE_LENGTH) & (F.size(F.get(sequence, F.lit(0))) == FEATURE_COUNT),
        F.lit(False),
    )


def batch_shape(sequence: Column) -> Column:
    """Right length and every row has the right width."""
    return F.coalesce(
        (F.size(sequence) == SEQUENCE_LENGTH) & F.forall(sequence, lambda row: F.size(row) == FEATURE_COUNT),
        F.lit(False),
    )


def raw_reason() -> Column:
    """Why a raw message is refused, or null. Needs the parsed ``doc`` and its ``keys``."""
    return (
        F.when(F.col("keys").isNull(), "malformed")
        .when(~includes_keys(F.col("keys"), RAW_KEYS), "missing_key")
        .when(F.col("doc._corrupt_record").isNotNull(), "bad_type")
        .when(~right_length(F.col("doc.sequence")), "sequence_length")
        .when(~parallel(F.col("doc.sequence"), F.col("doc.human_readable")), "parallel_length")
    )


def scoring_reason() -> Column:
    return (
        F.when(F.col("keys").isNull(), "malformed")
        .when(~includes_keys(F.col("keys"), SCORING_KEYS), "missing_key")
        .when(F.col("doc._corrupt_record").isNotNull(), "bad_type")
        .when(~right_length(F.col("doc.sequence")), "sequence_length")
        .when(~batch_shape(F.col("doc.sequence")), "batch_shape")
    )


def parsed(messages: DataFrame) -> DataFrame:
    """Each message parsed once: ``doc`` and the key names, null for broken JSON."""
    value = F.col("value")
    return computed_once(messages, doc=parse_message(value), keys=F.json_object_keys(value))


def checked(messages: DataFrame, reason: Column) -> DataFrame:
    """Parsed message and reject reason in one pass; filter on ``reason`` for either side."""
    return parsed(messages).withColumn("reason", reason)


def _fields(log: DataFrame) -> list[Column | str]:
    kept = [c for c in log.columns if c not in ("value", "doc", "keys", "reason")]
    return [*kept, *[F.col(f"doc.{f.name}").alias(f.name) for f in MESSAGE.fields if f.name not in kept]]


def valid_messages(log: DataFrame) -> DataFrame:
    return log.filter(F.col("reason").isNull()).select(*_fields(log))


def rejected_messages(log: DataFrame, source: str) -> DataFrame:
    return log.filter(F.col("reason").isNotNull()).select(
        F.lit(source).alias("source"), "reason", "value", "record_ts"
    )


def readable_messages(messages: DataFrame) -> DataFrame:
    """Bounded read of a topic: every message that is JSON, parsed; the rest is skipped."""
    log = parsed(messages)
    return log.filter(F.col("keys").isNotNull()).select(*_fields(log))


def reset_defaults(valid: DataFrame, processed_at: Column) -> DataFrame:
    """Verdict fields back to their defaults; training flag and familiarity stay."""
    return valid.withColumns(
        {
            "timestamp": processed_at,
            "is_anomaly": F.lit(False),
            "is_false_positive": F.lit(False),
            "reconstruction_error": F.lit(None).cast("double"),
        }
    )


def training_matrices(messages: DataFrame) -> DataFrame:
    return messages.select("_id", "sequence")


# Allowed kinds per field of a stored document; any other field may be anything.
TYPED_FIELDS = {
    "timestamp": "date",
    "sequence": "array",
    "is_training": "bool",
    "human_readable": "array",
    "is_anomaly": "bool",
    "reconstruction_error": "double",
    "is_false_positive": "bool",
}


def typed_violations(value: Column) -> Column:
    """Names of the present fields whose kind is not allowed. Null for broken JSON."""
    document = F.try_parse_json(value)
    wrong = []
    for name, kind in TYPED_FIELDS.items():
        field = F.try_variant_get(document, f"$.{name}", "variant")
        shape = F.schema_of_variant(field)
        text = F.try_variant_get(document, f"$.{name}", "string")
        fits = {
            "date": (shape == "STRING") & F.try_to_timestamp(text).isNotNull(),
            "array": shape.startswith("ARRAY") | (shape == "VOID"),
            "bool": shape.isin("BOOLEAN", "VOID"),
            "double": shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT", "BIGINT", "VOID"),
        }[kind]
        wrong.append(F.when(field.isNotNull() & ~fits, F.lit(name)))
    return F.when(is_json_object(value), F.array_compact(F.array(*wrong)))
