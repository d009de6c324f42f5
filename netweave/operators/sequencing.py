"""Fixed-count packet sequences, their scaling and their familiarity.

Shape of the plan: one pass gives each packet its arrival number per sensor (see
``plans.ordering``), which fixes the epoch, a run of ``reset_every`` packets. From
there on all work is local to (sensor, epoch), at most ``reset_every`` rows, so the
packets are shuffled once by that pair and the windows below share the exchange.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.features import feature_columns, gap_scaled, has_all_fields, human_fields
from netweave.plans.ordering import ROWS_PER_SPLIT, first_rows, ordinals, sliding
from netweave.plans.small import broadcast_if_small
from netweave.schemas import FEATURE_COUNT, FEATURES, RESET_EVERY, SEQUENCE_LENGTH

EPOCH = ["sensor_id", "epoch"]
SEQUENCE = ["sensor_id", "epoch", "seq_no"]
GAP_FEATURE = 3


@dataclass(frozen=True)
class SequenceRule:
    length: int = SEQUENCE_LENGTH
    reset_every: int = RESET_EVERY
    order: list[str] = field(default_factory=lambda: ["ts", "packet_id"])
    rows_per_split: int = ROWS_PER_SPLIT


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def number_epochs(packets: DataFrame, rule: SequenceRule) -> DataFrame:
    """Arrival number per sensor over all packets, and the epoch it falls into."""
    placed = ordinals(packets, rule.order, "arrival", ["sensor_id"], rows_per_split=rule.rows_per_split)
    return placed.withColumn("epoch", epoch_of(F.col("arrival"), rule))


def epoch_of(arrival: Column, rule: SequenceRule) -> Column:
    return F.floor((arrival - 1) / rule.reset_every).cast("long")


def place_packets(packets: DataFrame, rule: SequenceRule) -> DataFrame:
    """Usable packets with sequence number and position; the incomplete tail is dropped."""
    return place_in_epochs(number_epochs(packets, rule), rule)


def place_in_epochs(numbered: DataFrame, rule: SequenceRule) -> DataFrame:
    """The same from packets whose ``arrival`` and ``epoch`` are known.

    The explicit exchange matters when the arrival numbers came from windows per
    sensor: without it the work below would keep that partitioning, one task a sensor.
    """
    usable = numbered.filter(has_all_fields()).repartition(*EPOCH)
    in_order = Window.partitionBy(*EPOCH).orderBy("arrival")
    in_epoch = Window.partitionBy(*EPOCH)
    return (
        usable.withColumn("vi", F.row_number().over(in_order) - 1)
        .withColumn("_valid", F.count("*").over(in_epoch))
        .withColumn("seq_no", F.floor(F.col("vi") / rule.length).cast("long"))
        .withColumn("pos", (F.col("vi") % rule.length).cast("int"))
        .filter(F.col("seq_no") < F.floor(F.col("_valid") / rule.length))
        .drop("_valid")
    )


def mark_new_pairs(placed: DataFrame) -> DataFrame:
    """Flag the first sight of an address pair in its epoch, over all and over training packets."""
    pair = Window.partitionBy(*EPOCH, "src_ip", "dst_ip")
    trained_at = F.when(F.col("is_training"), F.col("vi"))
    return (
        placed.withColumn("new_pair", (F.col("vi") == F.min("vi").over(pair)).cast("int"))
        .withColumn("_first_trained", F.min(trained_at).over(pair))
        .withColumn("new_trained", F.coalesce((F.col("vi") == F.col("_first_trained")).cast("int"), F.lit(0)))
    )


def running_pairs(placed: DataFrame) -> DataFrame:
    """Distinct pairs seen so far in the epoch, at every packet."""
    so_far = Window.partitionBy(*EPOCH).orderBy("vi").rowsBetween(Window.unboundedPreceding, 0)
    return mark_new_pairs(placed).select(
        "*",
        F.sum("new_pair").over(so_far).alias("seen"),
        F.sum("new_trained").over(so_far).alias("trained"),
    )


def familiarity(seen: Column, trained: Column) -> Column:
    """0 without any training pair; otherwise the share of pairs not seen in training."""
    return F.when(trained == 0, F.lit(0.0)).otherwise(1.0 - trained / seen)


def sequence_familiarity(placed: DataFrame) -> DataFrame:
    """Per sequence: pairs seen and trained up to its end, and the familiarity."""
    per_sequence = (
        mark_new_pairs(placed)
        .groupBy(*SEQUENCE)
        .agg(F.sum("new_pair").alias("_seen"), F.sum("new_trained").alias("_trained"))
    )
    return _running_familiarity(per_sequence).drop("_seen", "_trained")


def _running_familiarity(per_sequence: DataFrame) -> DataFrame:
    """``_seen_before`` and ``_trained_before``, where given, count what the epoch had shown earlier."""
    so_far = Window.partitionBy(*EPOCH).orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)

    def total(name: str) -> Column:
        here = F.sum(name).over(so_far)
        return here + F.coalesce(f"{name}_before", F.lit(0)) if f"{name}_before" in per_sequence.columns else here

    return (
        per_sequence.withColumn("seen", total("_seen"))
        .withColumn("trained", total("_trained"))
        .withColumn("familiarity", familiarity(F.col("seen"), F.col("trained")))
    )


def own_pair_familiarity(placed: DataFrame, rule: SequenceRule) -> DataFrame:
    """Share of a sequence's own pairs that no training packet showed up to its end."""
    own = Window.partitionBy(*SEQUENCE, "src_ip", "dst_ip")
    pairs = (
        mark_new_pairs(placed)
        .withColumn("_end", (F.col("seq_no") + 1) * rule.length)
        .withColumn("_first_here", F.min("pos").over(own))
        .filter(F.col("pos") == F.col("_first_here"))
    )
    known = F.coalesce(F.col("_first_trained") < F.col("_end"), F.lit(False))
    return (
        pairs.groupBy(*SEQUENCE)
        .agg(F.count("*").alias("pairs"), F.count_if(known).alias("known_pairs"))
        .withColumn("familiarity", 1.0 - F.col("known_pairs") / F.col("pairs"))
    )


def packet_gaps(placed: DataFrame) -> DataFrame:
    """Seconds since the previous packet of the same sequence, null at its start."""
    before = F.lag("ts").over(Window.partitionBy(*EPOCH).orderBy("vi"))
    gap = seconds(F.col("ts")) - seconds(before)
    return placed.withColumn("gap", F.when(F.col("pos") > 0, gap))


def sequence_id() -> Column:
    """The same sequence always gets the same id, so a replay does not duplicate it."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in SEQUENCE]), 256)


def assemble(placed: DataFrame, rule: SequenceRule) -> DataFrame:
    """One row per sequence: matrix, readable records, flags and counters.

    Feature 3 of every row is the scaled mean gap of the sequence; the IP flags that
    stood there are kept in the readable record only. Vectors and records are
    collected apart, so a plan that needs only one of them does not carry the other.
    """
    return assemble_marked(mark_new_pairs(placed), rule)


def assemble_marked(marked: DataFrame, rule: SequenceRule, before: DataFrame | None = None) -> DataFrame:
    """The same from packets whose new pairs are flagged; ``before``: per open epoch, what was counted earlier."""
    features = feature_columns()
    vector = F.struct("pos", F.array(*[features[f] for f in FEATURES]).alias("features"))
    human = F.struct("pos", F.struct(*[c.alias(n) for n, c in human_fields().items()]).alias("human"))
    span = (F.max_by("_us", "pos") - F.min_by("_us", "pos")) / F.lit(1e6)
    grouped = (
        marked.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
        .groupBy(*SEQUENCE)
        .agg(
            F.sort_array(F.collect_list(vector)).alias("_vectors"),
            F.sort_array(F.collect_list(human)).alias("_humans"),
            (span / (rule.length - 1)).alias("mean_gap"),
            F.max_by("is_training", "pos").alias("is_training"),
            F.max_by("ts", "pos").alias("ts"),
            F.sum("new_pair").alias("_seen"),
            F.sum("new_trained").alias("_trained"),
        )
        .withColumn("gap_feature", gap_scaled(F.col("mean_gap")))
    )

    if before is not None:
        known = before.select(*[F.col(c).alias(f"_known_{c}") for c in EPOCH], "_seen_before", "_trained_before")
        same = F.lit(True)
        for name in EPOCH:
            same = same & F.col(name).eqNullSafe(F.col(f"_known_{name}"))
        grouped = grouped.join(known, same, "left")

    def with_gap(entry: Column) -> Column:
        return F.transform(
            entry["features"], lambda x, i: F.when(i == GAP_FEATURE, F.col("gap_feature")).otherwise(x)
        )

    return _running_familiarity(grouped).select(
        sequence_id().alias("_id"),
        *SEQUENCE,
        "ts",
        "is_training",
        "mean_gap",
        F.transform("_vectors", with_gap).alias("unscaled"),
        F.transform(
            "_humans", lambda e: e["human"].withField("avg_inter_packet_time", F.col("mean_gap"))
        ).alias("human_readable"),
        "seen",
        "trained",
        "familiarity",
    )


def column_of(matrix: Column, j: Column) -> Column:
    return F.transform(matrix, lambda row: F.get(row, j))


def quantile_of_sorted(values: Column, n: int, q: float) -> Column:
    """Linear interpolation between the two neighbours in a sorted array of ``n`` values."""
    at = q * (n - 1)
    low = int(at)
    below = F.get(values, F.lit(low))
    above = F.get(values, F.lit(min(low + 1, n - 1)))
    return below + (above - below) * F.lit(at - low)


def guard_spread(spread: Column) -> Column:
    """A feature without spread is only centred."""
    return F.when(spread < 1e-12, F.lit(1.0)).otherwise(spread)


def quartile_params(matrix: Column, n: int) -> Column:
    """(median, spread) per feature of one ``n``-row matrix."""

    def median_and_spread(ordered: Column) -> Column:
        spread = quantile_of_sorted(ordered, n, 0.75) - quantile_of_sorted(ordered, n, 0.25)
        return F.struct(
            quantile_of_sorted(ordered, n, 0.5).alias("median"), guard_spread(spread).alias("iqr")
        )

    features = F.sequence(F.lit(0), F.lit(FEATURE_COUNT - 1))
    columns = F.transform(features, lambda j: F.sort_array(column_of(matrix, j)))
    return F.transform(columns, median_and_spread)


def scale_matrix(matrix: Column, params: Column) -> Column:
    return F.transform(
        matrix, lambda row: F.zip_with(row, params, lambda x, p: (x - p["median"]) / p["iqr"])
    )


def scale_by_first(sequences: DataFrame, rule: SequenceRule) -> DataFrame:
    """Scale each sequence with the quartiles of the first sequence of its epoch."""
    return scale_by_params(with_first_params(sequences, rule))


def with_first_params(sequences: DataFrame, rule: SequenceRule) -> DataFrame:
    """Add ``_params``, the quartiles of the epoch's first sequence; null where that one is not there."""
    in_epoch = Window.partitionBy(*EPOCH).orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(F.col("seq_no") == 0, quartile_params(F.col("unscaled"), rule.length))
    return sequences.withColumn("_params", F.first(first, ignorenulls=True).over(in_epoch))


def scale_by_params(sequences: DataFrame) -> DataFrame:
    return (
        sequences.withColumn("sequence", scale_matrix(F.col("unscaled"), F.col("_params")))
        .drop("_params")
    )


def build_sequences(packets: DataFrame, rule: SequenceRule | None = None) -> DataFrame:
    """Packets with ``is_training`` to scaled sequences."""
    rule = rule or SequenceRule()
    return scale_by_first(assemble(place_packets(packets, rule), rule), rule)


def fit_scaler(sequences: DataFrame, scope: str = "first") -> DataFrame:
    """Median and spread per feature of an epoch, from a chosen set of its sequences.

    ``scope``: "first" sequence, whole "epoch", or only its "training" sequences.
    """
    chosen = {
        "first": F.col("seq_no") == 0,
        "epoch": F.lit(True),
        "training": F.col("is_training"),
    }[scope]
    rows = sequences.filter(chosen).select(*EPOCH, F.explode("unscaled").alias("row"))
    quartiles = [
        F.percentile(F.get("row", F.lit(j)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f)
        for j, f in enumerate(FEATURES)
    ]
    params = F.array(
        *[
            F.struct(
                F.get(F.col(f), F.lit(1)).alias("median"),
                guard_spread(F.get(F.col(f), F.lit(2)) - F.get(F.col(f), F.lit(0))).alias("iqr"),
            )
            for f in FEATURES
        ]
    )
    return rows.groupBy(*EPOCH).agg(*quartiles).select(*EPOCH, params.alias("params"))


def apply_scaler(sequences: DataFrame, params: DataFrame) -> DataFrame:
    """Scale sequences by the parameters of their epoch."""
    return (
        sequences.join(params, EPOCH)
        .withColumn("sequence", scale_matrix(F.col("unscaled"), F.col("params")))
        .drop("params")
    )


def min_max_scale(rows: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """Each column onto [0, 1] by the extremes of its group; null without spread."""
    ends = rows.groupBy(*group).agg(
        *[F.min(c).alias(f"_min_{c}") for c in columns], *[F.max(c).alias(f"_max_{c}") for c in columns]
    )
    scaled = {
        c: F.try_divide(F.col(c) - F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(f"_min_{c}")) for c in columns
    }
    helpers = [f"_{e}_{c}" for e in ("min", "max") for c in columns]
    return rows.join(broadcast_if_small(ends), group).withColumns(scaled).drop(*helpers)


def feature_statistics(sequences: DataFrame, column: str = "sequence") -> DataFrame:
    """Min, max, mean and population deviation per feature of a sequence; feature -1 is all cells."""

    def entry(feature: int, values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda t, v: t + v)
        return F.struct(
            F.lit(feature).alias("feature"), values.alias("v"), (total / F.size(values)).alias("mean")
        )

    def stats(e: Column) -> Column:
        spread = F.aggregate(
            e["v"], F.lit(0.0), lambda t, v: t + (v - e["mean"]) * (v - e["mean"])
        )
        return F.struct(
            e["feature"].alias("feature"),
            F.array_min(e["v"]).alias("min"),
            F.array_max(e["v"]).alias("max"),
            e["mean"].alias("mean"),
            F.sqrt(spread / F.size(e["v"])).alias("std"),
        )

    entries = [entry(j, column_of(F.col(column), F.lit(j))) for j in range(FEATURE_COUNT)]
    entries.append(entry(-1, F.flatten(column)))
    return sequences.select("_id", *SEQUENCE, F.inline(F.transform(F.array(*entries), stats)))


def sliding_sequences(
    rows: DataFrame, rule: SequenceRule, item: Column, name: str = "sequence", block: int = 10_000
) -> DataFrame:
    return sliding(
        rows, rule.order, rule.length, item, name, ["sensor_id"], block, rule.rows_per_split
    )


def latest_sequence(rows: DataFrame, rule: SequenceRule, item: Column, name: str = "sequence") -> DataFrame:
    """The last ``length`` items of each sensor, oldest first; sensors with fewer give null."""
    last = first_rows(
        rows, rule.order, rule.length, ["sensor_id"], descending=True, rows_per_split=rule.rows_per_split
    )
    return (
        last.groupBy("sensor_id")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("at"), item.alias("item")))).alias("_s"))
        .select(
            "sensor_id",
            F.when(F.size("_s") == rule.length, F.transform("_s", lambda e: e["item"])).alias(name),
        )
    )


def latest_packet(packets: DataFrame, order: list[str]) -> DataFrame:
    newest = F.max_by(F.struct(*[c for c in packets.columns if c != "sensor_id"]), F.struct(*order))
    return packets.groupBy("sensor_id").agg(newest.alias("p")).select("sensor_id", "p.*")


def newest_packets(packets: DataFrame, n: int, rule: SequenceRule) -> DataFrame:
    """Bounded history: the newest ``n`` packets of each sensor."""
    return first_rows(
        packets, rule.order, n, ["sensor_id"], descending=True, rows_per_split=rule.rows_per_split
    )
