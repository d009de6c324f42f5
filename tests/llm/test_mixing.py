from collections import Counter, defaultdict
from fractions import Fraction
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netweave.llm import mixing
from netweave.llm.queries import QUERIES


def test_query_meets_every_target(spark, small):
    rows = QUERIES["op7_source_mixing"](spark, small).collect()
    given = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    assert len(rows) == len(given)
    for r in rows:
        own = given[r["doc_id"]]
        assert r["size"] == len([w for w in own["text"].encode().split()])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        sizes[own["source"]] += r["size"]
        taken[own["source"]] += r["taken"]
    order = sorted(sizes)
    left, open_sources, targets = Fraction(sum(sizes.values())), dict(zip(order, [5, 2, 1] * 9)), {}
    while True:
        unit = left / sum(open_sources.values())
        full = [s for s, w in open_sources.items() if unit * w > 3 * sizes[s]]
        if not full:
            targets |= {s: unit * w for s, w in open_sources.items()}
            break
        for s in full:
            targets[s] = Fraction(3 * sizes[s])
            left -= targets[s]
            del open_sources[s]
    largest = max(r["size"] for r in rows)
    for r in rows:
        source = given[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and abs(r["target"] - float(targets[source])) < 1e-6
    assert all(abs(taken[s] - targets[s]) <= largest for s in sizes)
    again = QUERIES["op7_source_mixing"](spark, small).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_flow_has_least_cost():
    capacity, members, quota = {"a": 3, "b": 2, "ab": 2}, {"a": ["A"], "b": ["B"], "ab": ["A", "B"]}, {"A": 6, "B": 5}
    flow = mixing.min_cost_flow(capacity, quota, members)
    cost = lambda p, n: sum(min(max(n - k * capacity[p], 0), capacity[p]) * c for k, c in enumerate((0, 1, 3)))
    total = lambda f: sum(cost(p, sum(v for (q, _), v in f.items() if q == p)) for p in capacity)
    best = min(
        total({("a", "A"): x, ("b", "B"): y, ("ab", "A"): 6 - x, ("ab", "B"): 5 - y})
        for x, y in product(range(7), range(6))
        if x <= 9 and y <= 6 and 11 - x - y <= 6
    )
    assert flow["a", "A"] + flow["ab", "A"] == 6 and flow["b", "B"] + flow["ab", "B"] == 5 and total(flow) == best


def test_overlapping_sources(spark):
    frame = spark.createDataFrame([(i, "w " * (1 + i % 5), ["x", "y"] if i % 3 == 0 else ["x"] if i % 3 == 1 else ["y", None]) for i in range(400)], "doc_id long, text string, s array<string>")
    rows = mixing.mix(frame, F.col("s")).collect()
    assert len(rows) == 400 and sum(r["taken"] for r in rows) > 0 and all(0 <= r["copies"] <= 3 for r in rows)
    copied = mixing.mix_rows(frame, F.col("s"))
    assert copied.columns == frame.columns and copied.count() == sum(r["copies"] for r in rows)


def test_nulls_repeats_and_empty_tables(spark):
    frame = spark.createDataFrame(
        [(1, None, None, 1), (None, "a b", None, 1), (2, "", "z", 1), (3, "a b c", "z", 1), (3, "a b c", "z", 1)],
        "doc_id long, text string, source string, copies int",
    )
    rows = mixing.mix_by_source(frame).collect()
    assert len(rows) == 5 and {r["source_size"] for r in rows} == {2, 6}
    same = [r["taken"] for r in rows if r["doc_id"] == 3]
    assert same[0] == same[1]
    assert mixing.mix_by_source(frame.limit(0)).count() == 0
    assert mixing.mix_rows(frame.limit(0), F.array("source")).count() == 0
    assert mixing.mix_by_source(frame.filter("text is null or text = ''")).count() == 2


def step_cost(words, capacity):
    return sum(mixing.COSTS[i // capacity] for i in range(words)) if capacity else 0


@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from([("a",), ("b",), ("a", "b")])), min_size=1, max_size=3), st.integers(0, 7), st.integers(0, 7))
@settings(max_examples=60, deadline=None)
def test_flow_is_a_brute_force_optimum(patterns, quota_a, quota_b):
    """Of all ways to route words the most are moved, and of those at the least cost."""
    capacity = {f"p{i}": words for i, (words, _) in enumerate(patterns)}
    members = {f"p{i}": list(names) for i, (_, names) in enumerate(patterns)}
    quota = {"a": quota_a, "b": quota_b}
    routes = [(p, s) for p in capacity for s in members[p]]
    best = None
    for amounts in product(*[range(3 * capacity[p] + 1) for p, _ in routes]):
        taken, met = Counter(), Counter()
        for (p, s), n in zip(routes, amounts):
            taken[p] += n
            met[s] += n
        if all(taken[p] <= 3 * capacity[p] for p in capacity) and all(met[s] <= quota[s] for s in quota):
            value = (-sum(amounts), sum(step_cost(taken[p], capacity[p]) for p in capacity))
            best = value if best is None else min(best, value)
    flow = mixing.min_cost_flow(capacity, quota, members)
    taken = {p: sum(flow[p, s] for s in members[p]) for p in capacity}
    assert all(sum(flow[p, s] for p in capacity if s in members[p]) <= quota[s] for s in quota)
    assert (-sum(flow.values()), sum(step_cost(taken[p], capacity[p]) for p in capacity)) == best


def test_rows_without_an_id_have_places_of_their_own(spark):
    """100 different texts without an id, of which the mix takes a part: about the target, not all or none."""
    rows = [(None, f"w{i} x y z", "a") for i in range(100)] + [(i, f"v{i} " * 4, "b") for i in range(400)]
    found = mixing.mix_by_source(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source_size in (400, 1600):
        own = [r for r in found if r["source_size"] == source_size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4
