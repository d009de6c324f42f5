"""Steps whose tasks, files or results must follow the size of their input."""

import datetime as dt
import struct

from pyspark.sql import functions as F

from netweave.plans import ordering
from netweave.sources import captures, tables


def tasks_of(spark, group, run):
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return max((info.numTasks for s in stages if (info := tracker.getStageInfo(s))), default=0)


def test_cuts_for_many_pieces_take_few_tasks(spark):
    """a task for each piece sent the driver its report, however few rows a piece had."""
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = 40 * few
    found = []
    most = tasks_of(spark, "cuts", lambda: found.append(ordering.find_splits(rows, ["k", "id"], -(-5000 // pieces))))
    assert most <= max(few, rows.rdd.getNumPartitions())
    sizes = [r["count"] for r in rows.groupBy(found[0].piece()).count().collect()]
    assert len(sizes) >= pieces / 2 and max(sizes) <= 10 * 5000 / pieces
    one = ordering.Total("sum", F.lit(1))
    numbered = ordering.running(rows, ["id"], {"n": one}, ["k"], rows_per_split=-(-5000 // pieces))
    assert numbered.filter(F.col("n") != F.floor(F.col("id") / 7) + 1).count() == 0


def test_wide_rows_are_dealt_by_their_number(spark):
    """a table larger than the cores take at once is dealt to more tasks, of bounded size."""
    rows = spark.range(0, 10_000, 1, 2)
    assert tables.spread(rows, 500).rdd.getNumPartitions() == 20
    assert tables.spread(rows).rdd.getNumPartitions() == max(2, spark.sparkContext.defaultParallelism)
    assert sorted(r[0] for r in tables.spread(rows, 500).collect()) == list(range(10_000))


def test_a_run_reads_its_files_in_two_halves(spark, tmp_path):
    """F1, F2: a run's rows were two files, each of them a micro-batch of one task."""
    from checks.streams import in_two_runs

    at = F.when(F.col("id") < 600, F.lit(dt.datetime(2024, 1, 1))).otherwise(F.lit(dt.datetime(2024, 1, 20)))
    rows = spark.range(0, 1200, 1, 12).select("id", at.alias("at"))
    halves, seen = [], []

    def run(half):
        halves.append(half)
        seen.append(spark.read.parquet(str(tmp_path / "in")).count())

    in_two_runs(rows, "at", str(tmp_path / "in"), run)
    assert halves[0] == 3 and halves[1] >= 3 and seen == [600, 1200]  # Spark writes a file of no rows for the first task


def test_pieces_are_decoded_together(spark, tmp_path):
    """small pieces of one task share the array operations, and are walked and decoded by several tasks."""
    with open(tmp_path / "a.pcap", "wb") as out:
        out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for n in range(400):
            frame = bytes(12) + b"\x08\x06" + bytes(28 + n % 5)
            out.write(struct.pack("<IIII", 1_700_000_000 + n, n, len(frame), len(frame)) + frame)
    pieces = captures.find_pieces(spark, str(tmp_path), piece_bytes=700)
    own = pieces.filter("first < exit").toPandas()
    frames = list(captures._decode_pieces(iter([own])))
    assert len(own) > 30 and len(frames) == 1 and len(frames[0]) == 400
    found = captures.read_captures(spark, str(tmp_path), piece_bytes=700)
    rows = sorted((r["ts"].timestamp(), r["packet_size"]) for r in found.collect())
    assert rows == [(1_700_000_000 + n + n / 1e6, 42 + n % 5) for n in range(400)]
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
