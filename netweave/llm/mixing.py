"""Mix overlapping sources to target sizes by min-cost flow over membership patterns.

A document belongs to one or more sources. Documents with the same set of sources form a
pattern; only the patterns' total sizes reach the driver, one row each, whatever the number
of documents. Tokens flow from patterns to the quotas of their sources; taking a pattern's text a
second or third time costs more, so the flow spreads repetition as evenly as the overlaps
allow. A pattern that has to give ``f`` times its size gives every document ``floor(f)`` times and
a seeded part of its documents once more. The part is cut at a place in a hash order of the documents,
found by sums over hash ranges, so no task sorts a source.

Defined results: null texts have size 0. The null source is a source of its own, last in order.
Rows of one id and one text share a place in the hash order and are taken alike; all other rows, also without an id,
have places of their own. Extra columns, whatever their names, stay as they are.
Sources without words have target 0. An empty table gives an empty table. A document of
size 0 is taken with 0 words.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import packed, stored, words

WEIGHTS = (5, 2, 1)
MAX_TIMES = 3
#: What the first, second and third copy of a pattern's text cost per word: convex.
COSTS = (0, 1, 3)
#: Each step of the search for a cut looks at so many more bits of the place; the last range is ordered exactly.
PLACE_BITS = 62
RANGE_BITS = 10
STEPS = 2


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MAX_TIMES) -> dict[str | None, Fraction]:
    """Share all words by weight, sources in code point order and null last; none above ``most`` times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    open_sources, targets, left = list(order), dict.fromkeys(order, Fraction(0)), Fraction(total)
    while open_sources:
        unit = left / sum(weight[s] for s in open_sources)
        full = [s for s in open_sources if unit * weight[s] > most * sizes[s]]
        if not full:
            for s in open_sources:
                targets[s] = unit * weight[s]
            break
        for s in full:
            targets[s] = Fraction(most * sizes[s])
            left -= targets[s]
        open_sources = [s for s in open_sources if s not in full]
    return targets


def min_cost_flow(capacity: dict, quota: dict, members: dict, costs=COSTS) -> dict:
    """Words to move from each pattern to each of its sources.

    ``capacity``: words of a pattern, available once per cost level. ``members``: its
    sources. Successive shortest paths with potentials; as much of the quotas is met as
    capacities allow, at the least total cost of repetition.
    """
    nodes = {"start": 0, "end": 1}
    edges: list[list[int]] = []
    at: list[list[int]] = [[], []]

    def node(name) -> int:
        if name not in nodes:
            nodes[name] = len(nodes)
            at.append([])
        return nodes[name]

    def edge(a: int, b: int, room: int, cost: int) -> int:
        edges.append([b, room, cost])
        edges.append([a, 0, -cost])
        at[a].append(len(edges) - 2)
        at[b].append(len(edges) - 1)
        return len(edges) - 2

    routes = {}
    for pattern, words_there in capacity.items():
        for cost in costs:
            edge(0, node(("pattern", pattern)), words_there, cost)
        for source in members[pattern]:
            routes[pattern, source] = edge(node(("pattern", pattern)), node(("source", source)), len(costs) * words_there, 0)
    for source, wanted in quota.items():
        edge(node(("source", source)), 1, wanted, 0)
    potential = [0] * len(nodes)
    while True:
        best, came = [None] * len(nodes), [-1] * len(nodes)
        best[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for e in at[a]:
                b, room, cost = edges[e]
                if room:
                    reach = d + cost + potential[a] - potential[b]
                    if best[b] is None or reach < best[b]:
                        best[b], came[b] = reach, e
                        heapq.heappush(heap, (reach, b))
        if best[1] is None:
            break
        for i, d in enumerate(best):
            if d is not None:
                potential[i] += d
        room, b = None, 1
        while b:
            e = came[b]
            room = edges[e][1] if room is None else min(room, edges[e][1])
            b = edges[e ^ 1][0]
        b = 1
        while b:
            e = came[b]
            edges[e][1] -= room
            edges[e ^ 1][1] += room
            b = edges[e ^ 1][0]
    return {pair: edges[e ^ 1][1] for pair, e in routes.items()}


def _keyed(documents: DataFrame, sources: Column, seed: int) -> DataFrame:
    """``given``, all columns of a row, with its id, word count, sorted sources, their key and its place in the hash order.

    In a pattern null stands as "n" and a source as "s" and its name, so that both can be keys.
    """
    marked = F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), s.cast("string")), F.lit("n")))
    pattern = F.array_sort(F.array_distinct(F.coalesce(marked, F.array(F.lit("n")))))
    id_ = F.col("doc_id").cast("long")
    return documents.select(
        packed(documents), id_.alias("id"),
        F.size(words(F.col("text"))).cast("long").alias("mix_size"), pattern.alias("mix_pattern"), F.to_json(pattern).alias("mix_key"),
        # 62 bits, never negative
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_, "text"), 2).alias("mix_place"),
    )


def _of_key(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[F.col("mix_key")]


@dataclass
class Plan:
    """What decides: copies of every document of a pattern, and the place below which one more is taken."""

    whole: dict[str, int]
    stop: dict[str, int]
    members: dict[str, list[str]]
    sizes: dict[str, int]
    targets: dict[str, float]
    flow: dict[tuple[str, str], int]

    def copies(self) -> Column:
        if not self.whole:
            return F.lit(0)
        more = F.coalesce(F.col("mix_place") < _of_key(self.stop), F.lit(False)) if self.stop else F.lit(False)
        return (_of_key(self.whole) + more.cast("int")).cast("int")

    def of_sources(self, values: dict, kind: str) -> Column:
        if not values:
            return F.array().cast(f"array<{kind}>")
        known = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
        return F.transform("mix_pattern", lambda s: known[s].cast(kind))


def _stops(rows: DataFrame, rest: dict[str, int]) -> dict[str, int]:
    """For each pattern the place below which documents sum up to about ``rest`` words."""
    if not rest:
        return {}
    prefix, before, shift = dict.fromkeys(rest, 0), dict.fromkeys(rest, 0), PLACE_BITS
    for _ in range(STEPS):
        inside = rows.filter(F.shiftright("mix_place", shift) == _of_key(prefix))
        shift -= RANGE_BITS
        sums: dict[str, dict[int, int]] = {}
        # at most 2 ** RANGE_BITS rows for each pattern
        for row in inside.groupBy("mix_key", F.shiftright("mix_place", shift).alias("piece")).agg(F.sum("mix_size")).collect():
            sums.setdefault(row[0], {})[row[1]] = row[2]
        for key in rest:
            for piece in sorted(sums[key]):
                prefix[key] = piece
                if before[key] + sums[key][piece] > rest[key]:
                    break
                before[key] += sums[key][piece]
    stop = {key: (prefix[key] + 1) << shift for key in rest}
    near = rows.filter(F.shiftright("mix_place", shift) == _of_key(prefix)).groupBy("mix_key", "mix_place").agg(F.sum("mix_size"))
    decided: set[str] = set()
    for key, place, size in near.orderBy("mix_key", "mix_place").toLocalIterator():
        if key not in decided and before[key] + size - rest[key] > rest[key] - before[key]:  # stopping before it is nearer
            stop[key] = place
            decided.add(key)
        before[key] += size
    return stop


def plan_mix(rows: DataFrame, weights=WEIGHTS, most: int = MAX_TIMES) -> Plan:
    """Targets, flow and cuts for rows with the columns of ``_keyed``; the driver sees a row per pattern."""
    patterns = rows.groupBy("mix_key", "mix_pattern").agg(F.sum("mix_size").alias("words")).collect()
    members = {p["mix_key"]: list(p["mix_pattern"]) for p in patterns}
    capacity = {p["mix_key"]: p["words"] for p in patterns}
    sizes: dict[str, int] = {}
    for key, names in members.items():
        for name in names:
            sizes[name] = sizes.get(name, 0) + capacity[key]
    named = source_targets({None if s == "n" else s[1:]: v for s, v in sizes.items()}, weights, most)
    # a document in several sources is counted once in what is shared out
    scale = Fraction(sum(capacity.values()), sum(sizes.values()) or 1)
    targets = {("n" if s is None else "s" + s): t * scale for s, t in named.items()}
    flow = min_cost_flow(capacity, {s: round(t) for s, t in targets.items()}, members, COSTS[:most])
    taken = {key: sum(flow[key, s] for s in members[key]) for key in capacity}
    whole = {key: taken[key] // capacity[key] if capacity[key] else 0 for key in capacity}
    rest = {key: left for key in capacity if (left := taken[key] - whole[key] * capacity[key])}
    return Plan(whole, _stops(rows, rest), members, sizes, {s: float(t) for s, t in targets.items()}, flow)


def mix(documents: DataFrame, sources: Column, seed: int = 7, weights=WEIGHTS, most: int = MAX_TIMES) -> DataFrame:
    """For each row its id, size, pattern of sources, their sizes and targets, and the copies and words taken.

    ``sources`` gives an array of the sources of a row; null entries are the null source.
    """
    small = ["mix_size", "mix_pattern", "mix_key", "mix_place"]
    rows = stored(_keyed(documents, sources, seed).select(F.col("id").alias("doc_id"), *small), "mixing-sizes")
    plan = plan_mix(rows, weights, most)
    return rows.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_pattern").alias("pattern"),
        plan.of_sources(plan.sizes, "long").alias("source_sizes"), plan.of_sources(plan.targets, "double").alias("targets"),
        plan.copies().alias("copies"), (F.col("mix_size") * plan.copies()).alias("taken"),
    )


def mix_rows(documents: DataFrame, sources: Column, seed: int = 7, weights=WEIGHTS, most: int = MAX_TIMES) -> DataFrame:
    """The mix itself: rows of ``documents`` as often as they are taken, all columns as they were."""
    rows = _keyed(documents, sources, seed)
    plan = plan_mix(stored(rows.select("mix_size", "mix_pattern", "mix_key", "mix_place"), "mixing-sizes"), weights, most)
    taken = rows.select("given", F.explode(F.array_repeat(F.lit(1), plan.copies())))
    return taken.select(*[F.col("given")[c].alias(c) for c in documents.columns])


def mix_by_source(documents: DataFrame, seed: int = 7) -> DataFrame:
    """Each document in the one source its row names."""
    return mix(documents, F.array("source"), seed).select(
        "doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken", "copies"
    )
