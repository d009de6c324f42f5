import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from netweave.llm import collocations
from netweave.llm.queries import ORACLES, QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_sequences(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", piece) for piece in re.split("[.,;:!?\x0a-\x0d]", lowered)]


def plain(rows, least, top):
    """rows: (lang, text)."""
    f, totals = {}, Counter()
    for lang, text in rows:
        own = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for ws in plain_sequences(text):
            totals[lang if lang is not None else "und"] += len(ws)
            for m in range(1, 5):
                own.update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner = p[i : i + m]
                    if 100 * a >= 80 * candidates[inner]:
                        dropped.add(inner)
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, left, right = min(((2000000 * a) // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(frame):
    assert frame.columns == COLUMNS
    return sorted(map(tuple, frame.collect()))


def test_query_agrees_with_its_sql_and_brute_force(spark, small):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in frame.select("lang", "text").collect()]
    own = found(QUERIES["op11_collocations"](spark, small))
    assert own and own == plain(rows, 30, 2000)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(duckdb.sql(ORACLES["op11_collocations"]).fetchall()) == own


def test_small_counts_ties_and_limits(spark, small):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in frame.select("lang", "text").collect()]
    for least, top in ((3, 50), (5, 100_000)):
        assert found(collocations.mine_collocations(frame, least, top)) == plain(rows, least, top)


def test_stretches_parts_and_units_do_not_show(spark, small, monkeypatch):
    """Local workers are forked before, so small sizes go in through the functions themselves."""
    frame = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    rows = [(r["lang"], r["text"]) for r in frame.select("lang", "text").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert found(collocations.mine_collocations(frame.repartition(7), 4, 500)) == plain(rows, 4, 500)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 6), st.lists(st.integers(0, 120), max_size=4))
@settings(max_examples=200, deadline=None)
def test_padding_rare_tails_keeps_frequent_prefix_sums(sequence, least, cuts):
    first, second, n = collocations.lead_windows(np.array(sequence, np.int64))

    def prefix_sums(parts):
        sums = Counter()
        for f, s, c in ((f, s, c) for part in parts for f, s, c in zip(*(x.tolist() for x in part))):
            words = [f >> 32, f & 0xFFFFFFFF, s >> 32, s & 0xFFFFFFFF]
            for m in range(1, 5):
                if words[m - 1]:
                    sums[tuple(words[:m])] += c
        return {p: c for p, c in sums.items() if c >= least}

    edges = [0, *sorted(min(c, len(first)) for c in cuts), len(first)]
    stretches = [(first[a:b], second[a:b], n[a:b]) for a, b in zip(edges, edges[1:])]
    plain_counts = Counter(tuple(sequence[i : i + m]) for m in range(1, 5) for i in range(len(sequence) - m + 1) if 0 not in sequence[i : i + m])
    assert prefix_sums([(first, second, n)]) == {p: c for p, c in plain_counts.items() if c >= least}
    assert prefix_sums([collocations.pad_rare_tails(*s, least) for s in stretches]) == prefix_sums([(first, second, n)])


@given(st.lists(st.text(st.sampled_from("aB .,\t\n\x0b\x1c\x85\xa0é!"), max_size=12), max_size=5))
@settings(max_examples=200, deadline=None)
def test_words_of_texts(texts):
    codes, found_words = collocations.split_words([t.encode() for t in texts])
    pieces, now = [], []
    for code in [*codes.tolist(), None]:
        if code is None or found_words[code] == collocations.BREAK:
            pieces.append(now)
            now = []
        else:
            now.append(found_words[code])
    assert [p for p in pieces if p] == [ws for t in texts for ws in plain_sequences(t) if ws]


def test_parts_of_windows():
    first, second = np.array([1, 1, 2, 2, 5]), np.array([0, 3, 1, 7, 0])
    part_of = collocations._part_finder([(1, 2), (2, 7), (2, 7), (9, 0)])
    assert part_of(first, second).tolist() == [0, 1, 1, 3, 3]


def test_nulls_repeats_long_texts_hot_words_and_clashing_columns(spark):
    rows = [(None, None), ("und", "a b a b. a b"), (None, "A B"), ("", "x y"), ("", "x y"), ("en", ""), ("en", "the " * 3000 + "end"), ("de", " ".join(f"w{i % 7} w{i % 3}" for i in range(4000)))]
    frame = spark.createDataFrame([(lang, t, "own", 1) for lang, t in rows], "lang string, text string, phrase string, first int")
    assert found(collocations.mine_collocations(frame, 2, 50)) == plain(rows, 2, 50)
    assert found(collocations.mine_collocations(frame.limit(0))) == []
    assert found(collocations.mine_collocations(spark.createDataFrame([("en", None)], "lang string, text string"))) == []


def test_scores_do_not_overflow(spark):
    big = 6_000_000_000_000_000_000
    frame = spark.createDataFrame([(2, big, big, big, 1, 1, 1, 1, 1)], "size int, a long, first_n long, last_n long, f02 long, f12 long, f22 long, f03 long, f13 long")
    (row,) = frame.select(collocations._lowest_cut().alias("cut")).collect()
    assert row["cut"]["score"] == 1_000_000


def test_dictionary_gives_numbers_and_words_back(spark):
    words = [("en", f"w{i}", i + 1) for i in range(300)] + [("de", "w1", 7), ("e", "nw1", 9)]
    frame = spark.createDataFrame(words + [("en", None, 5)], "lang string, word string, n long")
    dictionary = collocations.number_words(frame)
    numbers = [dictionary.numbers(lang, [w])[0] for lang, w, _ in words]
    assert sorted(numbers) == list(range(1, len(words) + 1)) and dictionary.numbers("en", ["x", "nw1"]).tolist() == [0, 0]
    langs, found_words, counts = dictionary.entries(np.array(numbers))
    assert [(a.decode(), b.decode(), c) for a, b, c in zip(langs, found_words, counts.tolist())] == words
