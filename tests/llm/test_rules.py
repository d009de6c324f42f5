import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from netweave.llm import rules
from netweave.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    found = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    inside = {j for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (
        len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(inside),
    )


@given(st.text(alphabet="ab \n\t\x0b\x85\xa0é#|\U0001f600", max_size=120))
@settings(max_examples=200, deadline=None)
def test_counts_agree_with_plain_python(text):
    assert rules.count_text(text.encode())[:5] == plain(text)


def test_query_agrees_on_every_document(spark, small):
    got = QUERIES["op2_quality_rules"](spark, small).toPandas().set_index("doc_id")
    for doc_id, text in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        row = got.loc[doc_id]
        want = plain(text)
        assert tuple(row[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row.base_failed and row.kept)


def test_kept_is_what_the_rules_say_one_after_the_other(spark, small):
    documents, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    counts = rules.text_counts(documents).select("*", *[c.alias(k) for k, c in rules.ratios().items()])
    found = rules.learn_rules(rules.text_counts(documents), labels)
    assert found
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_rules(documents, labels).collect()}
    rejected = 0
    for r in counts.collect():
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        hit = any(all(r[c.name] >= c.value if c.above else r[c.name] <= c.value for c in rule) for rule in found)
        assert kept[r["doc_id"]] == (not failed and not hit)
        rejected += hit and not failed
    assert rejected or all(any(c.name == "words" for c in rule) for rule in found)


def test_very_long_texts_are_counted_whole(spark):
    text = "word another #\n" * 60_000 + "last one here"
    (row,) = rules.text_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    want = (180_000 + 3, 60_000 * 12 + 11, 60_000, 59_999)
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"]) == want


def test_learned_list_separates_planted_junk(spark):
    generator = np.random.default_rng(5)
    x = np.column_stack([generator.random(600), generator.random(600)])
    bad = x[:, 0] > 0.8
    found = rules.learn(x, bad, ["a", "b"])
    wrong = np.zeros(600, bool)
    for rule in found:
        wrong |= rules.covered(rule, x, ["a", "b"])
    assert (wrong == bad).mean() > 0.98 and rules.rule_text(found)


def test_nulls_empty_tables_and_extra_columns(spark):
    documents = spark.createDataFrame(
        [(1, None, "x"), (None, "", "y"), (2, "a " * 30, "z"), (2, "a " * 30, "z")], "doc_id long, text string, kept string"
    )
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (9, 0)], "doc_id long, quality int")
    rows = sorted(rules.apply_rules(documents, labels).collect(), key=str)
    assert len(rows) == 4 and [r.n_words for r in rows if r.doc_id == 2] == [30, 30]
    assert all(r.base_failed and not r.kept for r in rows)
    assert rules.apply_rules(documents.limit(0), labels).count() == 0
    assert rules.apply_rules(documents, labels.limit(0)).count() == 4
