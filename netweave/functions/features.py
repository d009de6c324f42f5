"""Header fields to numbers in [-1, 1], and to the record an analyst reads."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from netweave.schemas import FEATURES

# IP protocol numbers and the scale ends of the header fields.
ICMP, IGMP, TCP, UDP = 1, 2, 6, 17
PROTOCOL_NAMES = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP"}
MAX_IPV4 = 4294967295
MAX_16_BIT = 65535
HALF_BYTE_RANGE = 127.5
HALF_FLAG_RANGE = 3.5
ABSENT = -1.0
OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4)


def ipv4_number(ip: Column, well_formed: bool = False) -> Column:
    """Dotted IPv4 text as a number; null for any other text.

    ``well_formed`` skips the check where a filter has made it already.
    """
    parts = F.split(ip, r"\.")
    a, b, c, d = (F.get(parts, F.lit(i)).try_cast("long") for i in range(4))
    number = ((a * 256 + b) * 256 + c) * 256 + d
    return number if well_formed else F.when(is_ipv4(ip), number)


def ip_scaled(ip: Column, well_formed: bool = False) -> Column:
    return ipv4_number(ip, well_formed) / F.lit(float(MAX_IPV4)) * 2 - 1


def log_scaled(field: Column) -> Column:
    return F.log1p(field.cast("double")) * (2 / math.log1p(MAX_16_BIT)) - 1


def byte_scaled(field: Column) -> Column:
    return field.cast("double") / HALF_BYTE_RANGE - 1


def flag_scaled(field: Column) -> Column:
    return field.cast("double") / HALF_FLAG_RANGE - 1


def gap_scaled(mean_gap: Column) -> Column:
    """Mean gap in seconds on a log scale where one second is 1."""
    scaled = F.log1p(mean_gap) * (2 / math.log1p(1)) - 1
    return (
        F.when(mean_gap > -1, scaled)
        .when(mean_gap == -1, F.lit(float("-inf")))
        .when(mean_gap < -1, F.lit(float("nan")))
    )


def by_protocol(tcp: Column, udp: Column, other: Column) -> Column:
    """A packet whose transport header was not decoded, such as a later fragment, takes the third branch."""
    proto = F.col("proto")
    decoded = F.coalesce("src_port", "dst_port", "tcp_flags", "tcp_window", "udp_len").isNotNull()
    return F.when((proto == TCP) & decoded, tcp).when((proto == UDP) & decoded, udp).otherwise(other)


def feature_columns() -> dict[str, Column]:
    """The 12 features of a packet row that ``has_all_fields``, by name."""
    absent = F.lit(ABSENT)
    values = [
        ip_scaled(F.col("src_ip"), well_formed=True),
        ip_scaled(F.col("dst_ip"), well_formed=True),
        log_scaled(F.col("ip_len")),
        flag_scaled(F.col("ip_flags")),
        byte_scaled(F.col("ttl")),
        byte_scaled(F.col("proto")),
        by_protocol(log_scaled(F.col("src_port")), log_scaled(F.col("src_port")), absent),
        by_protocol(log_scaled(F.col("dst_port")), log_scaled(F.col("dst_port")), absent),
        by_protocol(byte_scaled(F.col("tcp_flags")), log_scaled(F.col("udp_len")), absent),
        by_protocol(log_scaled(F.col("tcp_window")), absent, absent),
        absent,
        log_scaled(F.col("packet_size")),
    ]
    return dict(zip(FEATURES, values))


def has_all_fields() -> Column:
    """True when no header field needed by the packet's protocol is missing or unreadable."""
    common = (
        is_ipv4(F.col("src_ip"))
        & is_ipv4(F.col("dst_ip"))
        & F.col("ip_len").isNotNull()
        & F.col("ip_flags").isNotNull()
        & F.col("ttl").isNotNull()
        & F.col("packet_size").isNotNull()
    )
    ports = F.col("src_port").isNotNull() & F.col("dst_port").isNotNull()
    tcp = ports & F.col("tcp_flags").isNotNull() & F.col("tcp_window").isNotNull()
    udp = ports & F.col("udp_len").isNotNull()
    return F.col("proto").isNotNull() & common & by_protocol(tcp, udp, F.lit(True))


def protocol_name(proto: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PROTOCOL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, proto), F.lit("Unknown"))


def human_fields() -> dict[str, Column]:
    """Readable header fields; the key set depends on the protocol, absent keys are null."""
    nothing = F.lit(None).cast("int")
    zero = F.lit(0)
    return {
        "src_ip": F.col("src_ip"),
        "dst_ip": F.col("dst_ip"),
        "length": F.col("ip_len"),
        "flags": F.col("ip_flags"),
        "ttl": F.col("ttl"),
        "protocol": protocol_name(F.col("proto")),
        "src_port": by_protocol(F.col("src_port"), F.col("src_port"), zero),
        "dst_port": by_protocol(F.col("dst_port"), F.col("dst_port"), zero),
        "tcp_flags": by_protocol(F.col("tcp_flags"), nothing, nothing),
        "window": by_protocol(F.col("tcp_window"), nothing, nothing),
        "udp_len": by_protocol(nothing, F.col("udp_len"), nothing),
        "flags_or_len": by_protocol(nothing, nothing, zero),
        "window_or_padding": by_protocol(nothing, nothing, zero),
        "packet_size": F.col("packet_size"),
    }
