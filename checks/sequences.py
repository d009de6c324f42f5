"""Sequencing, scaling and familiarity on the packet view."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.catalog import query, r6, s6
from netweave.operators import featurize, sequencing as sq
from netweave.schemas import FEATURES
from netweave.sources.tables import packets

RULE = sq.SequenceRule(reset_every=v.RESET)
KEYS = ["sensor_id", "epoch", "seq_no"]


def labelled(spark, folder):
    border = F.lit(v.TRAINING_BEFORE).cast("timestamp_ntz")
    return packets(spark, folder).withColumn("is_training", F.col("ts") < border)


def placed(spark, folder):
    return sq.place_packets(labelled(spark, folder), RULE)


def unscaled(spark, folder):
    return sq.assemble(placed(spark, folder), RULE)


def sequences(spark, folder):
    return sq.build_sequences(labelled(spark, folder), RULE)


def exploded(rows, column="sequence"):
    """One row per packet of a matrix, features as rounded columns."""
    cells = [r6(F.get("row", F.lit(j))).alias(f) for j, f in enumerate(FEATURES)]
    return rows.select(*KEYS, F.posexplode(column).alias("pos", "row")).select(*KEYS, "pos", *cells)


def cells(source: str, names=FEATURES) -> str:
    return ", ".join(f"{s6(f'{source}{f}')} as {f}" for f in names)


SCALED_BODY = f"select sensor_id, epoch, seq_no, pos, {cells('')} from scaled"


@query("fixed_count_sequences", "C1", v.sql(v.PLACED, "select sensor_id, epoch, seq_no, count(*) as packets, min(packet_id) as first_packet, max(packet_id) as last_packet from placed group by 1, 2, 3"))
def fixed_count_sequences(spark, folder):
    return placed(spark, folder).groupBy(*KEYS).agg(
        F.count("*").alias("packets"), F.min("packet_id").alias("first_packet"), F.max("packet_id").alias("last_packet")
    )


@query("buffer_epochs", "C2", v.sql(v.EPOCHS, "select packet_id, sensor_id, arrival, epoch from epochs"))
def buffer_epochs(spark, folder):
    return sq.number_epochs(packets(spark, folder), RULE).select("packet_id", "sensor_id", "arrival", "epoch")


@query("inter_packet_gaps", "C3", v.sql(v.GAPS, f"select packet_id, pos, {s6('gap')} as gap from gaps"))
def inter_packet_gaps(spark, folder):
    return sq.packet_gaps(placed(spark, folder)).select("packet_id", "pos", r6(F.col("gap")).alias("gap"))


@query(
    "mean_gap_feature",
    "C4",
    v.sql(v.GAPS, f"select sensor_id, epoch, seq_no, {s6('mean_gap')} as mean_gap, {s6('ln(1 + mean_gap) / ln(2.0e0) * 2 - 1')} as gap_feature from seq_gaps"),
)
def mean_gap_feature(spark, folder):
    rows = unscaled(spark, folder)
    feature = F.get(F.get("unscaled", F.lit(0)), F.lit(3))
    return rows.select(*KEYS, r6(F.col("mean_gap")).alias("mean_gap"), r6(feature).alias("gap_feature"))


@query("gap_feature_on_every_row", "C5", v.sql(v.ROWS, f"select sensor_id, epoch, seq_no, pos, {cells('')} from feature_rows"))
def gap_feature_on_every_row(spark, folder):
    return exploded(unscaled(spark, folder), "unscaled")


def params_oracle(where: str) -> str:
    pairs = ", ".join(f"{s6(f'm_{f}')} as median_{f}, {s6(f'case when q_{f} < 1e-12 then 1 else q_{f} end')} as iqr_{f}" for f in FEATURES)
    return v.sql(f"{v.ROWS},\nparams as ({v.params_sql(where)})", f"select sensor_id, epoch, {pairs} from params")


def params_frame(params):
    wide = []
    for j, f in enumerate(FEATURES):
        entry = F.get("params", F.lit(j))
        wide += [r6(entry["median"]).alias(f"median_{f}"), r6(entry["iqr"]).alias(f"iqr_{f}")]
    return params.select("sensor_id", "epoch", *wide)


@query("robust_scaler_fit", "C6", params_oracle("seq_no = 0"))
def robust_scaler_fit(spark, folder):
    return params_frame(sq.fit_scaler(unscaled(spark, folder), "first"))


@query("robust_scaler_transform", "C7", v.sql(v.SCALED, SCALED_BODY))
def robust_scaler_transform(spark, folder):
    return exploded(sequences(spark, folder))


@query("scaler_refit_epoch", "C8", params_oracle("true"))
def scaler_refit_epoch(spark, folder):
    return params_frame(sq.fit_scaler(unscaled(spark, folder), "epoch"))


@query("scaler_refit_training", "C8", params_oracle("is_training"))
def scaler_refit_training(spark, folder):
    return params_frame(sq.fit_scaler(unscaled(spark, folder), "training"))


@query("scaler_parameter_join", "J5", v.sql(v.scaled_ctes("true"), SCALED_BODY))
def scaler_parameter_join(spark, folder):
    rows = unscaled(spark, folder)
    return exploded(sq.apply_scaler(rows, sq.fit_scaler(rows, "epoch")))


@query("seen_address_pairs", "C9", v.sql(v.PAIRS, "select packet_id, new_pair, seen from running_pairs"))
def seen_address_pairs(spark, folder):
    return sq.running_pairs(placed(spark, folder)).select("packet_id", "new_pair", "seen")


@query("trained_address_pairs", "C10", v.sql(v.PAIRS, "select packet_id, trained from running_pairs"))
def trained_address_pairs(spark, folder):
    return sq.running_pairs(placed(spark, folder)).select("packet_id", "trained")


@query("sequence_familiarity", "C11", v.sql(v.FAMILIARITY, f"select sensor_id, epoch, seq_no, seen, trained, {s6('familiarity')} as familiarity from familiar"))
def sequence_familiarity(spark, folder):
    rows = sq.sequence_familiarity(placed(spark, folder))
    return rows.withColumn("familiarity", r6(F.col("familiarity")))


@query(
    "own_pair_familiarity",
    "C12",
    v.sql(
        v.PAIRS,
        f"""select sensor_id, epoch, seq_no, count(*) as pairs, count(*) filter (where known) as known_pairs,
          {s6('1 - count(*) filter (where known) / cast(count(*) as double)')} as familiarity
        from (select sensor_id, epoch, seq_no, src_ip, dst_ip, bool_or(coalesce(first_trained < (seq_no + 1) * 16, false)) as known
          from marked group by all) group by 1, 2, 3""",
    ),
)
def own_pair_familiarity(spark, folder):
    rows = sq.own_pair_familiarity(placed(spark, folder), RULE)
    return rows.withColumn("familiarity", r6(F.col("familiarity")))


@query(
    "sequence_ids",
    "C13",
    v.sql(v.PLACED, "select distinct sensor_id, epoch, seq_no, sha256(concat_ws('|', sensor_id, cast(epoch as varchar), cast(seq_no as varchar))) as _id from placed"),
)
def sequence_ids(spark, folder):
    return placed(spark, folder).select(*KEYS, sq.sequence_id().alias("_id")).distinct()


@query("sequence_training_flag", "C14", v.sql(v.GAPS, "select sensor_id, epoch, seq_no, is_training from seq_gaps"))
def sequence_training_flag(spark, folder):
    return placed(spark, folder).groupBy(*KEYS).agg(F.max_by("is_training", "vi").alias("is_training"))


@query(
    "assembled_sequences",
    "C15, J7",
    v.sql(
        v.SCALED,
        f"""select s.sensor_id, s.epoch, s.seq_no, s.pos, {cells('s.')}, p.src_ip, p.dst_ip, {v.NAME_SQL} as protocol,
          p.packet_size, {s6('g.mean_gap')} as avg_inter_packet_time
        from scaled s join placed p on s.sensor_id = p.sensor_id and s.epoch = p.epoch and s.seq_no = p.seq_no and s.pos = p.pos
        join seq_gaps g on s.sensor_id = g.sensor_id and s.epoch = g.epoch and s.seq_no = g.seq_no""",
    ),
)
def assembled_sequences(spark, folder):
    paired = F.arrays_zip("sequence", "human_readable")
    rows = sequences(spark, folder).select(*KEYS, F.posexplode(paired).alias("pos", "p"))
    human = [F.col(f"p.human_readable.{c}").alias(c) for c in ("src_ip", "dst_ip", "protocol", "packet_size")]
    return rows.select(
        *KEYS,
        "pos",
        *[r6(F.get("p.sequence", F.lit(j))).alias(f) for j, f in enumerate(FEATURES)],
        *human,
        r6(F.col("p.human_readable.avg_inter_packet_time")).alias("avg_inter_packet_time"),
    )


LONG = ",\nlong as (" + " union all ".join(
    f"select sensor_id, epoch, seq_no, {j} as feature, {f} as x from scaled union all select sensor_id, epoch, seq_no, -1, {f} from scaled"
    for j, f in enumerate(FEATURES)
) + ")"


@query(
    "feature_statistics",
    "C16",
    v.sql(
        v.SCALED + LONG,
        f"""select sensor_id, epoch, seq_no, feature, {s6('min(x)')} as "min", {s6('max(x)')} as "max", {s6('avg(x)')} as mean, {s6('stddev_pop(x)')} as std
        from long group by 1, 2, 3, 4""",
    ),
)
def feature_statistics(spark, folder):
    stats = sq.feature_statistics(sequences(spark, folder)).drop("_id")
    return stats.withColumns({c: r6(F.col(c)) for c in ("min", "max", "mean", "std")})


@query(
    "sliding_sequences",
    "C17",
    v.sql(
        v.PACKETS,
        f"""select packet_id, sensor_id, s as size_sum, first_packet, n from (
          select packet_id, sensor_id, cast(sum(packet_size) over w as bigint) as s, first_value(packet_id) over w as first_packet, count(*) over w as n
          from packets window w as (partition by sensor_id order by ts, packet_id rows 15 preceding)) where n = 16""",
    ),
)
def sliding_sequences(spark, folder, rule=RULE):
    item = F.struct("packet_id", "packet_size")
    rows = packets(spark, folder).select("sensor_id", "ts", "packet_id", "packet_size")
    windows = sq.sliding_sequences(rows, rule, item)
    total = F.aggregate("sequence", F.lit(0).cast("long"), lambda t, e: t + e["packet_size"])
    return windows.select(
        "packet_id",
        "sensor_id",
        total.alias("size_sum"),
        F.get("sequence", F.lit(0))["packet_id"].alias("first_packet"),
        F.size("sequence").cast("long").alias("n"),
    )


@query(
    "latest_sequence",
    "C18",
    v.sql(
        v.PACKETS,
        """, last as (select *, row_number() over (partition by sensor_id order by ts desc, packet_id desc) as r, count(*) over (partition by sensor_id) as n from packets)
        select sensor_id, case when max(n) >= 16 then string_agg(cast(packet_id as varchar), ',' order by r desc) end as packet_ids from last where r <= 16 group by sensor_id""",
    ),
)
def latest_sequence(spark, folder):
    found = sq.latest_sequence(packets(spark, folder), RULE, F.col("packet_id").cast("string"))
    return found.select("sensor_id", F.array_join("sequence", ",").alias("packet_ids"))


@query(
    "latest_packet",
    "C19",
    v.sql(v.PACKETS, "select sensor_id, max_by(packet_id, ts) as packet_id, max(ts) as ts, max_by(packet_size, ts) as packet_size from packets group by sensor_id"),
)
def latest_packet(spark, folder):
    return sq.latest_packet(packets(spark, folder), ["ts", "packet_id"]).select("sensor_id", "packet_id", "ts", "packet_size")


@query(
    "bounded_history",
    "C20",
    v.sql(
        v.PACKETS,
        "select packet_id, sensor_id, cast(r as int) as rank from (select *, row_number() over (partition by sensor_id order by ts desc, packet_id desc) as r from packets) where r <= 1000",
    ),
)
def bounded_history(spark, folder):
    return sq.newest_packets(packets(spark, folder), 1000, RULE).select("packet_id", "sensor_id", "rank")


@query(
    "min_max_scaling",
    "D19",
    v.sql(
        v.PACKETS,
        "select packet_id, "
        + ", ".join(
            f"{s6(f'({x} - min({x}) over w) / nullif(max({x}) over w - min({x}) over w, 0)')} as {f}"
            for f, x in ((f, v.FEATURE_SQL[f]) for f in FEATURES)
        )
        + " from packets where proto is not null window w as (partition by sensor_id)",
    ),
)
def min_max_scaling(spark, folder):
    rows = featurize.featurize(packets(spark, folder)).select("packet_id", "sensor_id", *FEATURES)
    scaled = sq.min_max_scale(rows, FEATURES, ["sensor_id"])
    return scaled.select("packet_id", *[r6(F.col(f)).alias(f) for f in FEATURES])


@query(
    "most_unfamiliar_sequences",
    "C11",
    v.sql(
        v.FAMILIARITY,
        f"""select sensor_id, epoch, seq_no, seen, trained, {s6('familiarity')} as familiarity from familiar
        order by familiarity desc, sensor_id, epoch, seq_no limit 20""",
    ),
)
def most_unfamiliar_sequences(spark, folder):
    rows = sq.sequence_familiarity(placed(spark, folder))
    top = rows.orderBy(F.desc("familiarity"), *KEYS).limit(20)
    return top.withColumn("familiarity", r6(F.col("familiarity")))


@query(
    "trained_pair_membership",
    "J3",
    v.sql(
        v.PACKETS,
        f"""select p.packet_id, exists (select 1 from packets t where t.proto is not null and t.ts < timestamp '{v.TRAINING_BEFORE}'
          and t.src_ip = p.src_ip and t.dst_ip = p.dst_ip) as known_pair from packets p where p.proto is not null""",
    ),
)
def trained_pair_membership(spark, folder):
    from netweave.operators.serving import trained_membership

    rows = featurize.only_ip(labelled(spark, folder))
    return trained_membership(rows, rows.filter("is_training")).select("packet_id", "known_pair")


@query(
    "shared_pair_count",
    "S4",
    v.sql(
        v.PACKETS,
        f"""select count(*) as pairs from (select src_ip, dst_ip from packets where proto is not null
          intersect select src_ip, dst_ip from packets where proto is not null and ts < timestamp '{v.TRAINING_BEFORE}')""",
    ),
)
def shared_pair_count(spark, folder):
    from netweave.operators.serving import shared_pairs

    rows = featurize.only_ip(labelled(spark, folder))
    return shared_pairs(rows, rows.filter("is_training")).agg(F.count("*").alias("pairs"))


__all__ = ["exploded", "labelled", "placed", "sequences", "unscaled"]
