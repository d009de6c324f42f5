import random
from collections import defaultdict

import numpy as np
import pytest

from netweave.llm import common, parity
from netweave.llm.queries import QUERIES


def plain_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w.decode() for w in lowered.encode().split()]
    width = min(4, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} if found else set()


def plain_components(rows):
    """doc_id to (size, component) by comparing all pairs that share a shingle."""
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for shingle in s:
            holders[shingle].append(k)
    shared = defaultdict(int)
    for found in holders.values():
        for i, a in enumerate(found):
            for b in found[:i]:
                shared[b, a] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a][1]) + len(sets[b][1]) - n):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(s), least[root(k)]) for k, (i, s) in enumerate(sets)}


def found(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity.components(frame).collect()}


def family(seed, members, length, edits):
    """A text and copies of copies of it, each with some words replaced."""
    generator = random.Random(seed)
    texts = [[f"w{generator.randrange(3000)}" for _ in range(length)]]
    while len(texts) < members:
        words = list(generator.choice(texts))
        for _ in range(generator.randrange(edits + 1)):
            words[generator.randrange(len(words))] = f"x{generator.randrange(10**6)}"
        texts.append(words)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("chunk", [8, 512])
def test_components_agree_with_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(parity, "CHUNK", chunk)
    texts = [t for seed in range(12) for t in family(seed, 20, 6 + 31 * seed, 2 + seed)]
    texts += ["a b c", "A B c", "a b", "a", "a", "x y z a b c d"] + family(77, 40, 60, 3)
    random.Random(1).shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(frame) == plain_components(list(enumerate(texts)))


def test_query_agrees_with_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_parity_join"](spark, small).collect()}
    assert got == plain_components(rows)


def test_linked_sets_always_share_a_block():
    generator = np.random.default_rng(3)
    for _ in range(400):
        n = int(generator.integers(1, 400))
        tokens = np.unique(generator.integers(0, 1 << 63, n, dtype=np.uint64))
        d = parity.largest_difference(len(tokens), len(tokens))
        gone, new = int(generator.integers(0, d + 1)) // 2, int(generator.integers(0, d + 1)) // 2
        other = np.unique(np.concatenate([tokens[gone:], generator.integers(0, 1 << 63, new, dtype=np.uint64)]))
        shared = len(np.intersect1d(tokens, other))
        if 100 * shared < 85 * (len(tokens) + len(other) - shared):
            continue
        keys = [np.concatenate([parity.block_keys(s, b) for b in parity.bands(len(s))]) for s in (tokens, other)]
        assert len(np.intersect1d(*keys))
        a, b = (parity.bit_vector(s)[None, :] for s in (tokens, other))
        words = min(a.shape[1], b.shape[1])
        distance = np.bitwise_count(parity.folded(a, words) ^ parity.folded(b, words)).sum()
        assert distance <= len(tokens) + len(other) - 2 * shared


def test_unrelated_sets_hardly_meet():
    """Pairs inside blocks stay far below those of all sets, also where sets are large and have empty blocks."""
    generator = np.random.default_rng(5)
    for size, sets in ((1_600, 200), (5_000, 120), (20_000, 60)):
        keys = []
        for _ in range(sets):
            tokens = np.unique(generator.integers(0, (1 << 64) - 1, size + int(generator.integers(0, size // 10)), dtype=np.uint64))
            keys.append(np.unique(np.concatenate([parity.block_keys(tokens, b) for b in parity.bands(len(tokens))])))
        _, together = np.unique(np.concatenate(keys), return_counts=True)
        assert (together * (together - 1) // 2).sum() <= sets // 20


def test_sets_have_no_more_keys_than_is_counted_with():
    for n in [*range(1, 400), 1000, 5000, 50_000, 10**6]:
        assert sum(map(parity.block_count, parity.bands(n))) <= parity.KEYS_A_SHINGLE * n


def test_keys_are_as_wide_as_their_number_asks_for():
    assert [parity.key_bits(n) for n in (0, 1, 255, 10**6, 33 * 10**6, 2 * 10**9, 10**13, 1 << 62)] == [8, 8, 16, 24, 32, 40, 48, 64]


def test_steps_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared", lambda _: str(tmp_path))
    texts = [t for seed in range(4) for t in family(seed, 12, 80, 4)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(frame) == plain_components(list(enumerate(texts)))
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"parity-classes", "parity-rows"}


def test_nulls_repeats_and_empty_tables(spark):
    text = "one two three four five six"
    frame = spark.createDataFrame(
        [(4, text, 1), (4, text, 1), (9, text, 1), (None, text, 1), (2, None, 1), (3, " ", 1), (None, "other words", 1)],
        "doc_id long, text string, node int",
    )
    rows = sorted(map(tuple, parity.components(frame).collect()), key=str)
    assert rows == sorted([(4, 3, 4), (4, 3, 4), (9, 3, 4), (None, 3, 4), (2, 0, 2), (3, 0, 3), (None, 1, None)], key=str)
    assert parity.components(frame.limit(0)).count() == 0
    kept = parity.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [2, 3, 4]


def test_members_without_a_candidate_stay_out_of_the_second_comparison():
    """The second comparison of a task takes the members that the first one has marked."""
    generator = np.random.default_rng(3)
    base = np.unique(generator.integers(0, (1 << 64) - 1, 200, dtype=np.uint64))
    sets = [base, base[2:], np.unique(generator.integers(0, (1 << 64) - 1, 200, dtype=np.uint64)), base[3:]]
    data = [parity.bit_vector(s).tobytes() for s in sets]
    every = np.arange(4)
    pairs = parity._forest(np.array([len(s) for s in sets]), data, np.array([0, 1, 2, 0]), every, every)
    assert {p for p in pairs if p[0] == p[1]} == {(0, 0), (1, 1), (3, 3)}
    assert len({p for p in pairs if p[0] != p[1]}) == 1
