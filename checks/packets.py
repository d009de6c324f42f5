"""Packet filters, features, records and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.catalog import query, r6, s6
from netweave.functions import features as fx
from netweave.operators import detectors, featurize
from netweave.schemas import FEATURES
from netweave.sources import captures
from netweave.sources.tables import packets, table

HOST = "192.168.1.2"


@query(
    "upload_type_gate",
    "A2",
    """with names as (
      select page_id, concat(lower(regexp_replace(url, '[^A-Za-z0-9.]', '_', 'g')),
        case when page_id % 4 = 0 then '.pcap' when page_id % 4 = 1 then '.PCAP' when page_id % 4 = 2 then '.pcap.gz' else '' end) as file_name from pages)
      select page_id, file_name, instr(file_name, '.') > 0 and lower(split_part(file_name, '.', -1)) = 'pcap' as allowed from names""",
)
def upload_type_gate(spark, folder):
    part = F.col("page_id") % 4
    ending = F.when(part == 0, ".pcap").when(part == 1, ".PCAP").when(part == 2, ".pcap.gz").otherwise("")
    name = F.concat(F.lower(F.regexp_replace("url", "[^A-Za-z0-9.]", "_")), ending)
    names = table(spark, folder, "pages").select("page_id", name.alias("file_name"))
    return names.withColumn("allowed", captures.allowed_file(F.col("file_name")))


@query(
    "watched_port_packets",
    "A4",
    v.sql(
        v.PACKETS,
        f"select packet_id, sensor_id, proto, dst_port from packets where proto in (6, 17) and dst_port in (80, 443) and dst_ip = '{HOST}'",
    ),
)
def watched_port_packets(spark, folder):
    kept = featurize.watched_ports(packets(spark, folder), HOST, [80, 443])
    return kept.select("packet_id", "sensor_id", "proto", "dst_port")


@query("packets_with_ip_layer", "B1", v.sql(v.PACKETS, "select packet_id, proto, packet_size from packets where proto is not null"))
def packets_with_ip_layer(spark, folder):
    return featurize.only_ip(packets(spark, folder)).select("packet_id", "proto", "packet_size")


@query(
    "ip_address_scaling",
    "B2",
    v.sql(
        v.PACKETS,
        f"select packet_id, {v.ip_sql('src_ip')} as src_number, {s6(v.FEATURE_SQL['f0'])} as f0, {s6(v.FEATURE_SQL['f1'])} as f1 from packets where proto is not null",
    ),
)
def ip_address_scaling(spark, folder):
    rows = featurize.only_ip(packets(spark, folder))
    return rows.select(
        "packet_id",
        fx.ipv4_number(F.col("src_ip")).alias("src_number"),
        r6(fx.ip_scaled(F.col("src_ip"))).alias("f0"),
        r6(fx.ip_scaled(F.col("dst_ip"))).alias("f1"),
    )


@query(
    "log_scaled_fields",
    "B3",
    v.sql(
        v.PACKETS,
        "select packet_id, "
        + ", ".join(f"{s6(v.log_sql(c))} as {c}" for c in ("ip_len", "src_port", "dst_port", "tcp_window", "udp_len", "packet_size"))
        + " from packets",
    ),
)
def log_scaled_fields(spark, folder):
    fields = ("ip_len", "src_port", "dst_port", "tcp_window", "udp_len", "packet_size")
    return packets(spark, folder).select("packet_id", *[r6(fx.log_scaled(F.col(c))).alias(c) for c in fields])


@query("ip_flag_scaling", "B4", v.sql(v.PACKETS, f"select packet_id, {s6('ip_flags / 3.5e0 - 1')} as flag_feature from packets"))
def ip_flag_scaling(spark, folder):
    return packets(spark, folder).select("packet_id", r6(fx.flag_scaled(F.col("ip_flags"))).alias("flag_feature"))


@query(
    "byte_scaled_fields",
    "B5",
    v.sql(v.PACKETS, "select packet_id, " + ", ".join(f"{s6(v.byte_sql(c))} as {c}" for c in ("ttl", "proto", "tcp_flags")) + " from packets"),
)
def byte_scaled_fields(spark, folder):
    return packets(spark, folder).select(
        "packet_id", *[r6(fx.byte_scaled(F.col(c))).alias(c) for c in ("ttl", "proto", "tcp_flags")]
    )


@query(
    "protocol_branch_features",
    "B6",
    v.sql(
        v.PACKETS,
        "select packet_id, " + ", ".join(f"{s6(v.FEATURE_SQL[f])} as {f}" for f in FEATURES[6:11]) + " from packets where proto is not null",
    ),
)
def protocol_branch_features(spark, folder):
    columns = fx.feature_columns()
    rows = featurize.only_ip(packets(spark, folder))
    return rows.select("packet_id", *[r6(columns[f]).alias(f) for f in FEATURES[6:11]])


@query("protocol_names", "B7, F13", v.sql(v.PACKETS, f"select {v.NAME_SQL} as protocol, count(*) as packets from packets where proto is not null group by 1"))
def protocol_names(spark, folder):
    named = featurize.only_ip(packets(spark, folder)).select(fx.protocol_name(F.col("proto")).alias("protocol"))
    return named.groupBy("protocol").agg(F.count("*").alias("packets"))


@query(
    "readable_records",
    "B8",
    v.sql(
        v.PACKETS,
        f"""select packet_id, src_ip, dst_ip, ip_len as length, ip_flags as flags, ttl, {v.NAME_SQL} as protocol,
        case when proto in (6, 17) then src_port else 0 end as src_port, case when proto in (6, 17) then dst_port else 0 end as dst_port,
        case when proto = 6 then tcp_flags end as tcp_flags, case when proto = 6 then tcp_window end as "window",
        case when proto = 17 then udp_len end as udp_len, case when proto in (6, 17) then null else 0 end as flags_or_len,
        case when proto in (6, 17) then null else 0 end as window_or_padding, packet_size from packets where proto is not null""",
    ),
)
def readable_records(spark, folder):
    return featurize.featurize(packets(spark, folder)).select("packet_id", "human_readable.*")


@query(
    "packet_features",
    "B9, F12",
    v.sql(v.PACKETS, "select packet_id, " + ", ".join(f"{s6(v.FEATURE_SQL[f])} as {f}" for f in FEATURES) + " from packets where proto is not null"),
)
def packet_features(spark, folder):
    return featurize.featurize(packets(spark, folder)).select("packet_id", *[r6(F.col(f)).alias(f) for f in FEATURES])


@query(
    "feature_width_check",
    "B10",
    """with vectors as (select vec_id, len(embedding[1:12 - cast(vec_id % 3 = 0 as int)]) as width from embeddings)
    select vec_id, width from vectors where width = 12""",
)
def feature_width_check(spark, folder):
    width = F.lit(12) - (F.col("vec_id") % 3 == 0).cast("int")
    vectors = table(spark, folder, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), width).alias("features"))
    return featurize.well_sized(vectors).select("vec_id", F.size("features").cast("long").alias("width"))


@query(
    "safe_numbers",
    "B11",
    """with texts as (select event_id, case when event_id % 3 = 0 then cast(event_id as varchar) when event_id % 3 = 1 then cast(value as varchar) else props end as word from events)
    select event_id, coalesce(cast(case when regexp_matches(word, '^[0-9]+$') then try_cast(word as bigint) end as double), try_cast(word as double), 0.0e0) as number from texts""",
)
def safe_numbers(spark, folder):
    part = F.col("event_id") % 3
    word = F.when(part == 0, F.col("event_id").cast("string")).when(part == 1, F.col("value").cast("string")).otherwise(F.col("props"))
    return table(spark, folder, "events").select("event_id", featurize.safe_number(word).alias("number"))


@query(
    "training_window_label",
    "B23, T7",
    v.sql(
        v.PACKETS,
        "select packet_id, ts >= greatest(timestamp '2024-01-03 00:00:00', timestamp '2024-01-04 12:00:00') and ts <= timestamp '2024-01-09 06:00:00' as is_training from packets",
    ),
)
def training_window_label(spark, folder):
    start, asked, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-03 00:00:00", "2024-01-04 12:00:00", "2024-01-09 06:00:00"))
    return packets(spark, folder).select("packet_id", featurize.in_training_window(F.col("ts"), start, end, asked).alias("is_training"))


WINDOWS = "windows as (select ts as start, ts + interval 5 minute as \"end\" from events where event_type = 'purchase')"


@query(
    "training_window_join",
    "J4",
    v.sql(
        v.PACKETS + ",\n" + WINDOWS,
        "select packet_id, exists (select 1 from windows w where p.ts between w.start and w.\"end\") as is_training from packets p",
    ),
)
def training_window_join(spark, folder):
    asked = table(spark, folder, "events").filter(F.col("event_type") == "purchase")
    windows = asked.select(F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("end"))
    return featurize.label_training(packets(spark, folder), windows).select("packet_id", "is_training")


@query(
    "open_ports",
    "B25",
    v.sql(v.PACKETS, "select src_ip, string_agg(cast(src_port as varchar), ',' order by src_port) as ports, cast(sum(n) as bigint) as replies from (select src_ip, src_port, count(*) as n from packets where proto = 6 and tcp_flags = 18 group by 1, 2) group by src_ip"),
)
def open_ports(spark, folder):
    found = detectors.open_ports(packets(spark, folder))
    return found.withColumn("ports", F.array_join(F.col("ports").cast("array<string>"), ","))


@query("malformed_headers", "B26", v.sql(v.PACKETS, "select packet_id, ihl, src_ip from packets where ihl < 5"))
def malformed_headers(spark, folder):
    return detectors.malformed_headers(packets(spark, folder)).select("packet_id", "ihl", "src_ip")


@query(
    "port_scan_windows",
    "E8",
    v.sql(
        v.PACKETS,
        """select time_bucket(interval 1 day, ts, timestamp '2024-01-01') as window_start, src_ip, dst_ip, count(distinct dst_port) as ports, count(*) as packets
        from packets where proto = 6 group by 1, 2, 3 having count(distinct dst_port) >= 2""",
    ),
)
def port_scan_windows(spark, folder):
    return detectors.port_scans(packets(spark, folder), "1 day", 2)


@query(
    "udp_flood_windows",
    "E9",
    v.sql(
        v.PACKETS,
        """select time_bucket(interval 6 hour, ts, timestamp '2024-01-01') as window_start, dst_ip, count(*) as packets, cast(sum(udp_len) as bigint) as bytes
        from packets where proto = 17 group by 1, 2 having count(*) >= 3""",
    ),
)
def udp_flood_windows(spark, folder):
    return detectors.udp_floods(packets(spark, folder), "6 hours", 3)


@query("approximate_pair_counts", "E7")
def approximate_pair_counts(spark, folder):
    return detectors.approximate_pairs(featurize.only_ip(packets(spark, folder)), ["sensor_id"])
