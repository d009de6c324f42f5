import hashlib

import pytest
from pyspark.sql import functions as F

from netweave.llm import winnow
from netweave.llm.queries import QUERIES


def marks_of(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: [tuple(m) for m in r["marks"]] for r in winnow.fingerprint(frame).collect()}


def plain_places(hashed):
    """Rightmost least of every window, from the k-gram hashes."""
    width = min(winnow.WINDOW, len(hashed))
    out = set()
    for s in range(len(hashed) - width + 1 if hashed else 0):
        window = hashed[s : s + width]
        out.add(s + max(i for i, h in enumerate(window) if h == min(window)))
    return sorted(out)


def gram_hashes(spark, text):
    found = [w.decode() for w in text.encode().split()]
    grams = [found[i : i + winnow.K] for i in range(max(len(found) - winnow.K, 0) + 1)] if found else []
    if len(found) < winnow.K:
        frame = spark.createDataFrame([(i, g) for i, g in enumerate(grams)], "i int, g array<string>")
        return [r[1] for r in sorted(frame.select("i", F.xxhash64("g")).collect())]
    words = spark.createDataFrame([(w,) for w in set(found)], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    known = {r["w"]: r["h"] % (1 << 64) for r in words}
    out = []
    for gram in grams:
        total = 0
        for j, word in enumerate(gram):
            places = winnow.K - 1 - j
            total ^= (known[word] << places) % (1 << 64)
        out.append(total - (1 << 64) if total >> 63 else total)
    return out


def test_marks_agree_with_plain_windows(spark):
    texts = ["a b c d e f g h i j k l m n o p q r s t", "x " * 40, "one", "", "a b\tc\nd \x0b e  f", "a b c d e", "a b c d", "p q " * 6]
    texts += [" ".join(f"w{i * i % 17}" for i in range(n)) for n in (11, 12, 13, 14, 60)]
    found = marks_of(spark, texts)
    for i, text in enumerate(texts):
        hashed = gram_hashes(spark, text)
        assert found[i] == [(p, hashed[p]) for p in plain_places(hashed)]


def test_a_shared_run_shares_a_mark(spark):
    run = " ".join(f"r{i}" for i in range(winnow.K + winnow.WINDOW - 1))
    found = marks_of(spark, [f"{'p ' * n}{run} q{n} z" for n in range(9)])
    for marks in found.values():
        assert {h for _, h in marks} & {h for _, h in found[0]}


def edited(rows):
    """Texts and edited texts in falling order of id."""
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        out[doc_id] = text[: len(text) - cut] + following[:cut]
    return out


@pytest.mark.parametrize("rows_per_band", [7, 1000])
def test_query_agrees_with_plain_python(spark, small, rows_per_band):
    given = spark.read.parquet(f"{small}/documents.parquet")
    texts = sorted(((r["doc_id"], r["text"]) for r in given.collect()), reverse=True)
    want = edited(texts)
    marks = marks_of(spark, [t for _, t in texts] + [want[d] for d, _ in texts])
    sets = [{h for _, h in marks[i]} for i in range(2 * len(texts))]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    rows = {r["doc_id"]: r for r in winnow.compare_with_next(given, rows_per_band).collect()}
    assert len(rows) == len(texts)
    for i, (doc_id, text) in enumerate(texts):
        r = rows[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(want[doc_id].encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(sets[i], sets[len(texts) + i]))
        assert r["near_next"] == pytest.approx(like(sets[i], sets[(i + 1) % len(texts)]))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (marks[i] == marks[len(texts) + i])


def test_nulls_repeats_and_empty_tables(spark):
    frame = spark.createDataFrame(
        [(5, "a b c", 1), (5, "a b c", 1), (None, "lone words here", 1), (None, None, 1), (1, "", 1)], "doc_id long, text string, band int"
    )
    rows = winnow.compare_with_next(frame, 1).collect()
    assert len(rows) == 5
    same = [r for r in rows if r["doc_id"] == 5]
    assert same[0]["fingerprint"] == same[1]["fingerprint"] != ""
    assert [r["fingerprint"] for r in rows if r["n_chars"] == 0] == ["", ""]
    assert winnow.compare_with_next(frame.limit(0)).count() == 0
    alone = winnow.compare_with_next(frame.limit(1)).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 5


def test_query_is_registered(spark, small):
    assert QUERIES["op10_winnowing"](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()
