"""Text, time and JSON helpers used by records and views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of shortened text in tables, text for a missing number.
TABLE_TEXT = 12
NOT_AVAILABLE = "N/A"


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def parse_iso(text: Column) -> Column:
    """ISO text to a UTC timestamp; a trailing Z is an offset of zero, bad text is null."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def format_iso(ts: Column) -> Column:
    """ISO text; microseconds are written only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def time_of_day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm:ss"), F.lit(""))


def truncate_text(text: Column, length: int = TABLE_TEXT) -> Column:
    shortened = F.when(F.length(text) <= length, text).otherwise(
        F.concat(F.substring(text, 1, length), F.lit("..."))
    )
    return F.coalesce(shortened, F.lit(""))


def truncate_value(value: Column, length: int = TABLE_TEXT) -> Column:
    """Nested values are shortened as JSON text."""
    return truncate_text(F.to_json(value), length)


def four_decimals(number: Column, zero_is_missing: bool) -> Column:
    missing = number.isNull() | (number == 0) if zero_is_missing else number.isNull()
    return F.when(missing, F.lit(NOT_AVAILABLE)).otherwise(F.format_string("%.4f", number))


def capitalise_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def status_class(status: Column) -> Column:
    return (
        F.when(status == "healthy", "status-healthy")
        .when(status == "Unknown", "loading")
        .otherwise("status-unhealthy")
    )


def utf8(data: Column) -> Column:
    """Bytes as text; bytes that are not UTF-8 become the replacement character."""
    return F.make_valid_utf8(data.cast("string"))


def json_record(**fields: Column) -> Column:
    """A record as JSON: decimals as text, times as ISO text, nulls kept."""
    return F.to_json(
        F.struct(*[value.alias(name) for name, value in fields.items()]), {"ignoreNullFields": "false"}
    )


def pretty(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})
