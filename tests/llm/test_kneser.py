import math
import zlib
from collections import Counter, defaultdict

import pytest

from netweave.llm import kneser
from netweave.llm.queries import QUERIES


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Plain:
    """The same model with dictionaries."""

    def __init__(self, rows):
        self.pairs, self.words = Counter(), Counter()
        for doc_id, text in rows:
            if doc_id is not None and not held_out(doc_id):
                found = ["<s>", *words(text), "</s>"]
                self.pairs.update(zip(found, found[1:]))
                self.words.update(found[1:])
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.follows = Counter(b for _, b in self.pairs)
        self.total, self.classes = Counter(), defaultdict(Counter)
        for (a, _), c in self.pairs.items():
            self.total[a] += c
            self.classes[a][min(c, 3)] += 1
        self.left = None
        self.d, self.e = (kneser.discounts(*[sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (self.pairs, self.follows))

    def lower(self, word):
        if not self.pairs:
            return 1 / (self.v + 1)
        if self.left is None:
            self.left = sum(self.e[min(c, 3) - 1] for c in self.follows.values())
        c = self.follows[word]
        return (max(c - self.e[min(c, 3) - 1], 0) * (c > 0) + self.left / (self.v + 1)) / len(self.pairs)

    def chance(self, before, word):
        if not self.total[before]:
            return self.lower(word)
        c = self.pairs[before, word]
        share = sum(n * self.d[k - 1] for k, n in self.classes[before].items()) / self.total[before]
        return (max(c - self.d[min(c, 3) - 1], 0) * (c > 0)) / self.total[before] + share * self.lower(word)

    def row(self, doc_id, text):
        found = ["<s>", *words(text), "</s>"]
        base = sum(math.log10((self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in found[1:])
        own = sum(math.log10(self.chance(a, b)) for a, b in zip(found, found[1:]))
        return held_out(doc_id), len(found) - 1, sum(self.words[w] > 0 for w in found[1:]), self.n, base, own


def check(got, rows):
    model = Plain(rows)
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        want = model.row(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r)[1:5] == want[:4]
        assert r["base_score"] == pytest.approx(want[4], rel=1e-9) and r["score"] == pytest.approx(want[5], rel=1e-9)
    return model


def test_query_agrees_with_dictionaries(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op5_kneser_ney"](spark, small).collect()
    model = check(got, rows)
    for before in ["<s>", b"the", b"never-seen"]:
        every = sum(model.chance(before, w) for w in model.words) + model.chance(before, "unknown")
        assert every == pytest.approx(1.0)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_many_units_and_ranges(spark, small, monkeypatch):
    monkeypatch.setattr(kneser, "UNIT_BYTES", 20_000)
    monkeypatch.setattr(kneser, "RANGE_BYTES", 30_000)
    frame = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).sortWithinPartitions("doc_id")
    check(kneser.score_documents(frame).collect(), rows)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "A b a b"), (None, "b a"), (2, None), (3, ""), (4, "a " * 5000)]
    frame = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, learned boolean")
    check(kneser.score_documents(frame).collect(), rows)
    twice = kneser.score_documents(frame.union(frame)).collect()
    assert len(twice) == 10 and len({tuple(r) for r in twice}) == 5
    assert kneser.score_documents(frame.limit(0)).count() == 0
    nothing = kneser.score_documents(frame.filter("doc_id is null")).first()
    assert nothing["train_tokens"] == 0 and nothing["score"] == 0.0
