"""Rule detectors for scans, floods, open ports and broken headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions.features import TCP, UDP
from netweave.operators.featurize import malformed_headers, syn_ack_replies


#: A sketch has 2 to this power registers; the standard error is 0.65 % at 14.
SKETCH_BITS = 14


def open_ports(packets: DataFrame) -> DataFrame:
    """Ports each host answered on with SYN-ACK."""
    return (
        syn_ack_replies(packets)
        .groupBy("src_ip")
        .agg(F.sort_array(F.collect_set("src_port")).alias("ports"), F.count("*").alias("replies"))
    )


def port_scans(packets: DataFrame, window: str, min_ports: int) -> DataFrame:
    """Address pairs with many distinct TCP target ports in one time window.

    Ports are made distinct before counting, so even a pair with very many packets
    sends at most one row per port and task.
    """
    per_port = (
        packets.filter(F.col("proto") == TCP)
        .groupBy(F.window("ts", window).start.alias("window_start"), "src_ip", "dst_ip", "dst_port")
        .agg(F.count("*").alias("packets"))
    )
    return (
        per_port.groupBy("window_start", "src_ip", "dst_ip")
        .agg(F.count("*").alias("ports"), F.sum("packets").alias("packets"))
        .filter(F.col("ports") >= min_ports)
    )


def udp_floods(packets: DataFrame, window: str, min_packets: int) -> DataFrame:
    """Hosts that receive many UDP packets in one time window."""
    return (
        packets.filter(F.col("proto") == UDP)
        .groupBy(F.window("ts", window).start.alias("window_start"), "dst_ip")
        .agg(F.count("*").alias("packets"), F.sum("udp_len").alias("bytes"))
        .filter(F.col("packets") >= min_packets)
    )


def pair_sketches(packets: DataFrame, window: str, group: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """Per window and group a sketch of its address pairs, some kilobytes whatever it has seen: kept, and merged later."""
    by = [F.window("ts", window).start.alias("window_start"), *[F.col(g) for g in group]]
    pair = F.concat_ws("|", "src_ip", "dst_ip")
    return packets.groupBy(*by).agg(F.hll_sketch_agg(pair, bits).alias("sketch"), F.count("*").alias("packets"))


def merged_pairs(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Approximate distinct pairs over any set of kept windows; a pair of several windows counts once."""
    return sketches.groupBy(*group).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("pairs"), F.sum("packets").alias("packets"))


def approximate_pairs(packets: DataFrame, group: list[str]) -> DataFrame:
    """Approximate number of distinct address pairs, as a number and as a mergeable sketch."""
    pair = F.concat_ws("|", "src_ip", "dst_ip")
    return packets.groupBy(*group).agg(
        F.approx_count_distinct(pair, 0.02).alias("pairs"),
        F.hll_sketch_estimate(F.hll_sketch_agg(pair)).alias("sketch_pairs"),
    )


__all__ = ["approximate_pairs", "malformed_headers", "merged_pairs", "open_ports", "pair_sketches", "port_scans", "udp_floods"]
