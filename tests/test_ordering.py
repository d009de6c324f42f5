"""The split path must equal a plain Python pass, also when one key or instant is hot."""

import random

import pytest
from pyspark.sql import functions as F

from netweave.plans import ordering as od
from netweave.plans.once import computed_once
from netweave.plans.small import broadcast_if_small


def hot_rows(n=3000):
    """One group holds a third of the rows, one instant another third."""
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else f"g{rnd.randrange(40)}"
        at = 500 if i % 3 == 1 else rnd.randrange(1000)
        rows.append((group, at, i, rnd.random()))
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return hot_rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, at int, id long, x double").repartition(6).cache()


def expected_ordinals(rows, descending=False):
    found, groups = {}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[2]), reverse=descending):
        groups[row[0]] = groups.get(row[0], 0) + 1
        found[row[2]] = groups[row[0]]
    return found


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("size", [10_000, 100])
def test_ordinals(frame, rows, size, descending):
    placed = od.ordinals(frame, ["at", "id"], "n", ["g"], descending, rows_per_split=size)
    assert {r["id"]: r["n"] for r in placed.collect()} == expected_ordinals(rows, descending)


def test_splits_are_even_whatever_is_hot(frame):
    splits = od.find_splits(frame, ["at", "id"], 100)
    sizes = [r["count"] for r in frame.withColumn("p", splits.piece()).groupBy("p").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400


def test_running_totals_without_group(frame, rows):
    totals = {
        "s": od.Total("sum", F.col("id")),
        "lo": od.Total("min", F.struct("x", "id")),
        "hi": od.Total("max", F.when(F.col("x") > 0.5, F.col("at"))),
    }
    got = {r["id"]: (r["s"], r["lo"]["id"], r["hi"]) for r in od.running(frame, ["at", "id"], totals, rows_per_split=100).collect()}
    s, lo, hi = 0, None, None
    for _, at, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        s += i
        lo = (x, i) if lo is None or (x, i) < lo else lo
        if x > 0.5:
            hi = at if hi is None else max(hi, at)
        assert got[i] == (s, lo[1], hi)


@pytest.mark.parametrize("size", [10_000, 100])
def test_row_at(frame, rows, size):
    ordered = sorted((r[3], r[2]) for r in rows)
    for share in (0.0, 0.5, 0.9):
        position = F.floor(F.col("n").cast("double") * share)
        found = od.row_at(frame.select("x", "id"), ["x", "id"], position, size).collect()
        assert [(r["x"], r["id"]) for r in found] == [ordered[int(len(ordered) * share)]]


@pytest.mark.parametrize("size", [10_000, 100])
def test_first_rows(frame, rows, size):
    got = od.first_rows(frame, ["at", "id"], 7, ["g"], True, rows_per_split=size)
    wanted = {i: n for i, n in expected_ordinals(rows, True).items() if n <= 7}
    assert {r["id"]: r["rank"] for r in got.collect()} == wanted


@pytest.mark.parametrize("size, block", [(10_000, 10_000), (100, 50), (100, 5)])
def test_sliding(frame, rows, size, block):
    got = od.sliding(frame, ["at", "id"], 5, F.col("id"), "last", ["g"], block, size)
    history, wanted = {}, {}
    for g, at, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        history.setdefault(g, []).append(i)
        if len(history[g]) >= 5:
            wanted[i] = history[g][-5:]
    assert {r["id"]: r["last"] for r in got.collect()} == wanted


def test_empty_table(spark):
    empty = spark.createDataFrame([], "g string, at int, id long, x double")
    assert od.ordinals(empty, ["at"], "n", ["g"]).count() == 0
    assert od.row_at(empty, ["at"], F.col("n") - 1).count() == 0


def test_computed_once_keeps_rows_and_is_not_substituted(spark):
    df = computed_once(spark.range(5).withColumn("a", F.lit(1)), b=F.col("id") * 2)
    assert [tuple(r) for r in df.filter("b > 3").orderBy("id").collect()] == [(2, 1, 4), (3, 1, 6), (4, 1, 8)]


def test_broadcast_only_below_the_bound(spark):
    table = spark.range(5)
    hinted = broadcast_if_small(table, 5)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint (strategy=broadcast)" in hinted or "UnresolvedHint broadcast" in hinted
    assert broadcast_if_small(table, 4) is table
    assert sorted(r["id"] for r in broadcast_if_small(table, 5).collect()) == list(range(5))
